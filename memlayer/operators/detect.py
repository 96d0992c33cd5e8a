"""Query classification and event detection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from memlayer.functions.arrow import record_batch
from memlayer.functions.text import SPACE, column, label_class, payload_text, similarity_note, words
from memlayer.functions.vectors import hash_embedding, head_argmax
from memlayer.operators.nearest import within
from memlayer.operators.nearest import within
from memlayer.sources.steps import materialize


def classify_regex(text: Column | str, rules: list[tuple[str, str]], default: str = "Unknown") -> Column:
    """The class of the first pattern that matches anywhere (CLS1, SF5)."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(column(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def read_head(text: str) -> dict:
    """A linear head from JSON, its shape checked (SRC13)."""
    head = json.loads(text)
    labels, dim, weights, bias = head["labels"], head["embedding_dim"], head["weights"], head["bias"]
    if not labels:
        raise ValueError("a head needs a label")
    if len(weights) != len(labels) or len(bias) != len(labels):
        raise ValueError("a head needs a row and a bias for each label")
    if any(len(row) != dim for row in weights):
        raise ValueError("a head's rows need the embedding's dimension")
    return head


def classify_linear(vector: Column | str, head: dict) -> Column:
    """The class of the head's best label (CLS2)."""
    names = F.array(*[F.lit(x) for x in head["labels"]])
    return label_class(F.get(names, head_argmax(vector, head["weights"], head["bias"])))


def train_head(rows: DataFrame, vector_col: str, label_col: str, labels: list[str], steps: int = 60, rate: float = 0.5) -> dict:
    """Multinomial logistic regression over all rows by full-batch gradient steps (CLS3); export it with :func:`write_head`.

    A step is one scan: each partition sums its part of the gradient in numpy, and only these sums, a number for each weight,
    meet. Rows with a null vector or another label, or of another dimension than the
    commonest, teach nothing.
    """
    import numpy as np
    import pandas as pd

    sizes = rows.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    dim, k = first[0] if first else 0, len(labels)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    data = rows.where((F.size(vector_col) == dim) & F.col(label_col).isin(*labels)).select(F.col(vector_col).alias("v"), place.cast("int").alias("y"))
    data = materialize(data, "head")
    w = np.zeros((k, dim + 1))

    def gradients(batches):
        total = np.zeros((k, dim + 2))  # the last column counts rows
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.stack(batch["v"].to_numpy()).astype(float), np.ones(len(batch))])
                z = x @ w.T
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), batch["y"]] -= 1
                total[:, :-1] += p.T @ x
                total[0, -1] += len(batch)
        yield pd.DataFrame({"at": range(total.size), "g": total.ravel()})

    for _ in range(steps):
        sums = data.mapInPandas(gradients, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
        total = np.zeros(k * (dim + 2))
        total[[x.at for x in sums]] = [x.g for x in sums]
        total = total.reshape(k, dim + 2)
        w = w - rate * total[:, :-1] / max(total[0, -1], 1)
    return {"labels": labels, "embedding_dim": dim, "weights": w[:, :-1].tolist(), "bias": w[:, -1].tolist()}


def write_head(spark: SparkSession, head: dict, path: str) -> None:
    """A head as one line of JSON that :func:`read_head` takes, written through Spark."""
    spark.range(1).select(F.lit(json.dumps(head)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_head_file(spark: SparkSession, path: str) -> dict:
    return read_head("\n".join(x.value for x in spark.read.text(path).collect()))


def classify_texts(df: DataFrame, id_col: str, text_col: str, head: dict, embed=hash_embedding) -> DataFrame:
    """``(id, class)``: embed each text, then the head (CLS2); ``embed(df, id, text)`` gives ``(id, embedding)``."""
    return embed(df, id_col, text_col).select("id", classify_linear("embedding", head).alias("class"))


def holdout_accuracy(rows: DataFrame, predicted: str, label: str, gate: float = 4 / 6) -> DataFrame:
    """Share of right predictions and whether it passes the gate (AGG13)."""
    right = F.avg((F.col(predicted) == F.col(label)).cast("double"))
    return rows.agg(right.alias("accuracy"), (right >= gate).alias("passed"))


def detect_keywords(df: DataFrame, id_col: str, text: Column, payload: Column, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """``(id, ordinal, label, matched)``: one row for each keyword contained, in rule order (DET1, JN6); case counts.

    The rules are few and known, so they are one array constant and the rows are scanned once.
    """
    flat = [(n, label, k) for n, (label, k) in enumerate((label, k) for label, ks in rules for k in ks)]
    whole = payload_text(text, payload)
    table = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(label).alias("label"), F.lit(k).alias("matched")) for n, label, k in flat]) if flat else F.array().cast("array<struct<ordinal:int,label:string,matched:string>>")
    hits = F.filter(table, lambda r: F.contains(F.col("_whole"), r["matched"]))
    return df.select(F.col(id_col).alias("id"), whole.alias("_whole")).select("id", F.explode(hits).alias("h")).select("id", "h.*")


#: Bytes of keywords of one automaton; more rules take more automata, a scan of the texts each.
RULE_BYTES = 16 << 20


def detect_rules(df: DataFrame, id_col: str, text: Column, payload: Column, rules: DataFrame, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """As :func:`detect_keywords` for a table ``rules(ordinal, label, keyword)`` of any size (DET1, JN6).

    One Aho-Corasick automaton finds all keywords in one pass over a text, however many there are. It is built once on the
    driver, from ``rule_bytes`` of keywords at most, and broadcast. Empty keywords are contained in every text; null ones
    match nothing.
    """
    import ahocorasick

    schema = StructType([StructField("id", df.schema[id_col].dataType)]).add("ordinal", "long").add("label", "string").add("matched", "string")
    rows = df.select(F.col(id_col).alias("id"), payload_text(text, payload).alias("whole")).where("whole is not null")
    out = None

    def scan(held: dict[str, list[tuple[int, str]]]) -> DataFrame:
        always = held.pop("", [])
        automaton = ahocorasick.Automaton()
        for word in held:
            automaton.add_word(word, word)
        if held:
            automaton.make_automaton()
        shared = df.sparkSession.sparkContext.broadcast((automaton if held else None, held, always))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, held, always = shared.value
            for batch in batches:
                found = []
                for id_, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = {w for _, w in automaton.iter(whole)} if automaton is not None else ()
                    found += [(id_, *rule, w) for w in words for rule in held[w]] + [(id_, *rule, "") for rule in always]
                if found:
                    yield record_batch(found, schema)

        return rows.mapInArrow(run, schema)

    held, size = {}, 0
    for rule in rules.select("ordinal", "label", "keyword").where("keyword is not null").toLocalIterator(prefetchPartitions=True):
        held.setdefault(rule.keyword, []).append((rule.ordinal, rule.label))
        size += len(rule.keyword) + 16
        if size >= rule_bytes:
            part = scan(held)
            out, held, size = part if out is None else out.union(part), {}, 0
    if held:
        part = scan(held)
        out = part if out is None else out.union(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def detect_similar(vectors: DataFrame, id_col: str, vector_col: str, references: DataFrame, threshold: float) -> DataFrame:
    """``(id, label, score, matched)`` of each reference ``(label, embedding)`` at least the threshold near (DET2, JN5)."""
    found = within(vectors, id_col, vector_col, references, "label", "embedding", threshold)
    return found.withColumn("matched", similarity_note("similarity", F.col("score")))


#: Passages of one row that a text meets where no word can stand for them.
PASSAGE_BLOCK = 256


def contains_join(texts: DataFrame, id_col: str, text_col: str, passages: DataFrame, passage_id: str, passage_col: str) -> DataFrame:
    """``(<id>, <passage id>)`` of every passage that a text contains, case folded (FLT7), by an equi-join on a word.

    A contained passage's words but the first and last are words of the text, so its longest inner word is looked up among the
    texts' words and the few pairs that meet are compared. Passages without an inner word go over all texts in blocks.
    """
    doc = texts.select(F.col(id_col).alias("i"), F.lower(text_col).alias("t")).where("t is not null")
    asked = passages.select(F.col(passage_id).alias("p"), F.lower(passage_col).alias("s")).where("s is not null")
    inner = F.slice(F.split("s", rf"{SPACE}+"), 2, F.greatest(F.size(F.split("s", rf"{SPACE}+")) - 2, F.lit(0)))
    asked = asked.withColumn("word", F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    keyed, short = asked.where("word is not null"), asked.where("word is null").select("p", "s")
    met = doc.select("i", "t", F.explode(F.array_distinct(words("t"))).alias("word")).join(keyed, "word")
    found = met.where(F.contains("t", F.col("s"))).select("i", "p")
    n = short.count()
    if n:
        blocks = short.groupBy(F.pmod(F.xxhash64("p"), F.lit(-(-n // PASSAGE_BLOCK))).alias("b")).agg(F.collect_list(F.struct("p", "s")).alias("ps"))
        more = doc.crossJoin(blocks).select("i", "t", F.explode("ps").alias("x")).where(F.contains("t", F.col("x.s"))).select("i", "x.p")
        found = found.union(more)
    return found.select(F.col("i").alias(id_col), F.col("p").alias(passage_id))


def cascade(stages: list[DataFrame]) -> DataFrame:
    """Events of the first stage that has any for an id (DET4, WIN10); each stage is ``(id, label, matched)``."""
    rows = None
    for n, s in enumerate(stages):
        part = s.select("id", "label", "matched", F.lit(n).alias("stage"))
        rows = part if rows is None else rows.union(part)
    first = F.min("stage").over(Window.partitionBy("id"))
    return rows.withColumn("_first", first).where("stage = _first").drop("_first")


def cascade_lazily(df: DataFrame, id_col: str, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """As :func:`cascade`, where a stage ``df -> (id, label, matched)`` sees only rows without events so far."""
    out, rest = None, df
    for n, stage in enumerate(stages):
        found = stage(rest).select("id", "label", "matched", F.lit(n).alias("stage"))
        out = found if out is None else out.union(found)
        rest = rest.join(found.select(F.col("id").alias("_id")).distinct(), rest[id_col] == F.col("_id"), "left_anti")
    return out
