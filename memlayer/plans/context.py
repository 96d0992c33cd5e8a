"""The context compiler: resident chunks, active facts and rescored related chunks, as one table and as a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlayer.functions.scoring import no_decay
from memlayer.operators.graph import chain
from memlayer.operators.postings import PostingIndex
from memlayer.operators.retrieval import bm25_one, build_index, drop_current
from memlayer.plans.protocols import PromptCompressor, QueryClassifier, RelevanceScorer, Retriever
from memlayer.sources.store import Store, active_facts

POOL, KEEP = 32, 8


def dynamic_layer(hits: DataFrame, chunks: DataFrame, score: Column, current: Column | None = None, keep: int = KEEP) -> DataFrame:
    """Hits ``(id, score)`` already cut to the pool -> the best ``keep`` chunks by ``score`` (WIN2, FLT5, FLT6, JN1).

    ``score`` is an expression over the chunk's columns and ``hit_score``. Ties: the better hit, then id.
    """
    pool = hits if current is None else drop_current(hits, current)
    rows = chunks.join(pool.select("id", F.col("score").alias("hit_score")), "id").withColumn("score", score)
    return rows.orderBy(F.desc("score"), F.desc("hit_score"), "id").limit(keep)


def compile_context(store: Store, query: str, current: str | None = None, scorer: RelevanceScorer | Column | None = None, retriever: Retriever | None = None, classifier: QueryClassifier | None = None, pool: int = POOL, keep: int = KEEP) -> DataFrame:
    """``(layer, pos, id, key, text, score, query_class)`` (CTX1): query, resident, fact and dynamic rows.

    ``retriever(query, k)`` gives ``(id, score)``; by default BM25 over the stored chunks. The class is recorded and
    does not change the route (CTX5).
    """
    spark, chunks = store.spark, store.read("chunk")
    # rounded, so that the last bits of a sum do not decide between copies
    hits = retriever(query, pool) if retriever else bm25_one(build_index(chunks, "id", "text"), spark, query, pool).withColumn("score", F.round("score", 9))
    kind = classifier(F.lit(query)) if classifier else F.lit(None).cast("string")
    columns = lambda layer, pos, id_, key, text, score: [F.lit(layer).alias("layer"), pos.cast("int").alias("pos"), id_.alias("id"), key.alias("key"), text.alias("text"), score.cast("double").alias("score")]
    none = F.lit(None).cast("string")
    out = spark.range(1).select(*columns("query", F.lit(0), none, none, F.lit(query), F.lit(None)))
    if current is not None:
        way = chain(chunks, "id", "parent", spark.range(1).select(F.lit(current).alias("start")))
        out = out.union(way.join(chunks, "id").select(*columns("resident", F.col("depth"), F.col("id"), none, F.col("text"), F.lit(None))))
    facts = active_facts(store.read("fact"))
    out = out.union(facts.select(*columns("fact", F.lit(0), F.col("id"), F.col("key"), F.col("value"), F.lit(None))))
    score = no_decay("hit_score") if scorer is None else scorer if isinstance(scorer, Column) else scorer(F.col("hit_score"))
    best = dynamic_layer(hits, chunks, score, F.lit(current) if current is not None else None, keep)
    ranked = best.agg(F.collect_list(F.struct("id", "text", "score")).alias("rows")).select(F.posexplode("rows").alias("pos", "r"))
    out = out.union(ranked.select(*columns("dynamic", F.col("pos"), F.col("r.id"), none, F.col("r.text"), F.col("r.score"))))
    return out.withColumn("query_class", F.when(F.col("layer") == "query", kind))


def compile_contexts(store: Store, queries: DataFrame, index: PostingIndex, scorer: Callable[[Column], Column] | None = None, classifier: QueryClassifier | None = None, pool: int = POOL, keep: int = KEEP) -> DataFrame:
    """The contexts of many queries in one plan: ``(query_id, layer, pos, id, key, text, score, query_class)`` (CTX1-3, CTX5).

    ``queries(query_id, query, current)`` may have more columns, such as a location; ``scorer`` sees them with ``q_`` before their
    names, beside the chunk's columns and the hit's score. Related chunks come from a kept index, the resident ones of all
    queries from one walk up. Active facts hold for every query and are listed once, without a query's id.
    """
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    chunks = store.read("chunk")
    none = F.lit(None).cast("string")
    kind = classifier(F.col("q_query")) if classifier else none

    def layer(rows: DataFrame, name: str, pos: Column, id_: Column, key: Column, text: Column, score: Column, query: Column, of: Column = none) -> DataFrame:
        return rows.select(query.alias("query_id"), F.lit(name).alias("layer"), pos.cast("int").alias("pos"), id_.alias("id"), key.alias("key"), text.alias("text"), score.cast("double").alias("score"), of.alias("query_class"))

    id_, text, own, no_score = F.col("id"), F.col("text"), F.col("q_query_id"), F.lit(None)
    out = layer(asked, "query", F.lit(0), none, none, F.col("q_query"), no_score, own, kind)
    starts = asked.where("q_current is not null").select(F.col("q_current").alias("start")).distinct()
    way = chain(chunks, "id", "parent", starts).join(asked, F.col("start") == F.col("q_current")).select("q_query_id", "id", "depth")
    out = out.union(layer(way.join(chunks, "id"), "resident", F.col("depth"), id_, none, text, no_score, own))
    facts = active_facts(store.read("fact"))
    out = out.union(layer(facts, "fact", F.lit(0), id_, F.col("key"), F.col("value"), no_score, F.lit(None).cast(asked.schema["q_query_id"].dataType)))
    hits = index.search(queries, "query_id", "query", pool).select(F.col("query_id").alias("q_query_id"), "id", F.col("score").alias("hit_score"))
    rows = chunks.join(hits.join(asked, "q_query_id").where("q_current is null or id <> q_current"), "id")
    rows = rows.withColumn("score", no_decay("hit_score") if scorer is None else scorer(F.col("hit_score")))
    best = Window.partitionBy("q_query_id").orderBy(F.desc("score"), F.desc("hit_score"), "id")
    rows = rows.withColumn("pos", F.row_number().over(best) - 1).where(F.col("pos") < keep)
    return out.union(layer(rows, "dynamic", F.col("pos"), id_, none, text, F.col("score"), own))


def rendered(resident: Column, facts: Column, related: Column, query: Column) -> Column:
    """The prompt (CTX4) from arrays: resident texts root first, ``(key, value)`` facts, related texts; empty parts are left out."""
    lines = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x, F.lit("\n\n"))), "")
    stated = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f["key"], F.lit(": "), f["value"], F.lit("\n"))), "")
    return F.concat(
        lines(resident),
        F.when(F.size(facts) > 0, F.concat(F.lit("## Facts\n"), stated, F.lit("\n"))).otherwise(""),
        F.when(F.size(related) > 0, F.concat(F.lit("## Related\n"), lines(related))).otherwise(""),
        F.lit("## Query\n"),
        query,
    )


def render(context: DataFrame, compressor: PromptCompressor | None = None) -> DataFrame:
    """One row ``(prompt)`` from :func:`compile_context`'s table.

    A prompt is one string, so what it holds has to fit a row: filter the facts of a large store before.
    """
    of = lambda layer, value, order: F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == layer, F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])
    rows = context.agg(
        of("resident", F.col("text"), -F.col("pos")).alias("r"),
        of("fact", F.struct("key", F.col("text").alias("value")), F.col("id")).alias("f"),
        of("dynamic", F.col("text"), F.col("pos")).alias("d"),
        F.max(F.when(F.col("layer") == "query", F.col("text"))).alias("q"),
    )
    text = rendered(F.col("r"), F.col("f"), F.col("d"), F.col("q"))
    return rows.select((compressor(text) if compressor else text).alias("prompt"))
