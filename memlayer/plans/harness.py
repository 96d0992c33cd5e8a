"""Evaluation runs: chunk, retrieve, join, compress and judge, for all cases and configurations in one plan."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.functions.text import JUDGE_SEPARATOR, chunk_documents, contains_any, words
from memlayer.operators import condense, evaluate, within
from memlayer.operators.postings import PostingIndex
from memlayer.plans.protocols import PromptCompressor
from memlayer.sources.steps import materialize, shared_dir

#: Chunk bytes, hits and compression budgets of the three benchmarks. Fixed values.
NIAH_CHUNK, QUESTION_CHUNK, HITS = 2048, 4096, 10
BUDGET, TAIL = 2048, 256


def _with_corpus(chunks: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where ``chunks`` names ``case_id`` instead of ``corpus``, each case is its own corpus."""
    if "corpus" in chunks.columns:
        return chunks, cases
    return chunks.withColumnRenamed("case_id", "corpus"), cases.withColumn("corpus", F.col("case_id"))


def retrieve_within(chunks: DataFrame, cases: DataFrame, k: int = HITS, hybrid: bool = False) -> DataFrame:
    """``chunks(corpus, id, text)`` and ``cases(case_id, corpus, question)`` -> ``(case_id, rank, text)`` (RET7, RET8).

    Document frequencies and mean lengths are taken by corpus; where ``chunks`` names ``case_id`` instead, each case is its own
    corpus. A chunk is tokenised and embedded once, whatever the number of its corpus's cases.
    """
    chunks, cases = _with_corpus(chunks, cases)
    corpora = materialize(within.corpora(chunks), "corpora")
    hits = within.best_places(corpora, cases, k, hybrid).select("case_id", "corpus", F.posexplode("places").alias("at", "place"))
    return hits.join(corpora, "corpus").select("case_id", (F.col("at") + 1).alias("rank"), F.get("texts", F.col("place")).alias("text"))


#: Settings of the three configurations: whether retrieval is hybrid and whether the context is compressed (CMP4). Fixed values.
CONFIGURATIONS = {"tier-0": (False, False), "tier-0-1": (True, False), "tier-0-1-2": (True, True)}


def compressor_for(spark: SparkSession, given: PromptCompressor | None = None, budget: int = BUDGET, tail: int = TAIL) -> PromptCompressor:
    """The compressor that the session's key ``memlayer.compressor`` names (CMP4): ``truncate`` (the default) or ``given``."""
    name = spark.conf.get("memlayer.compressor", "truncate" if given is None else "given")
    if name == "given" and given is not None:
        return given
    if name != "truncate":
        raise ValueError(f"no compressor {name}")
    return lambda text: condense.truncate(text, budget, tail)


def run_all(chunks: DataFrame, cases: DataFrame, ablations: tuple[str, ...] = evaluate.ABLATIONS, compressor: PromptCompressor | None = None) -> DataFrame:
    """Judge ``cases(case_id, question, accepted)`` under each configuration (EVL4): a row of case metrics each.

    Cases that share their chunks name them by a column ``corpus``, as :func:`retrieve_within` has it. Chunks are written once and each
    retrieval leg runs once, whatever the number of configurations; its hits are kept as places in their corpus, and contexts are put
    together where they are judged. Cases run together, so ``retrieval_latency_ms`` and ``latency_ms`` are the measured time of the leg,
    and of leg, compression and judging, over the number of cases. Tokens are words; nothing is generated, so ``completion_tokens`` is null.
    """
    spark = cases.sparkSession
    chunks, cases = _with_corpus(chunks, cases)
    corpora, cases = materialize(within.corpora(chunks), "corpora"), materialize(cases, "cases")
    total, legs, out = max(cases.count(), 1), {}, None
    each = lambda since: int(round((time.monotonic() - since) * 1000 / total))
    for ablation in ablations:
        hybrid, compressed = CONFIGURATIONS[ablation]
        if hybrid not in legs:
            since = time.monotonic()
            legs[hybrid] = materialize(within.best_places(corpora, cases, HITS, hybrid).select("case_id", "places"), "hits"), each(since)
        hits, spent = legs[hybrid]
        since = time.monotonic()
        rows = cases.select("case_id", "corpus", "accepted").join(hits.where(F.size("places") > 0), "case_id", "left").join(corpora, "corpus", "left")
        context = F.array_join(F.transform("places", lambda p: F.get("texts", p)), JUDGE_SEPARATOR)
        sizes = rows.select("case_id", "accepted", F.size("places").alias("retrieved_chunks"), context.alias("context"))
        sizes = sizes.withColumn("retrieval_chars", F.length("context").cast("long"))
        if compressed:
            sizes = sizes.withColumn("context", F.when(F.col("context").isNotNull(), compressor_for(spark, compressor)(F.col("context"))))
        done = sizes.withColumn("compressed_chars", F.length("context").cast("long")).withColumn("correct", contains_any(F.coalesce("context", F.lit("")), "accepted"))
        counted = done.select("case_id", F.lit(ablation).alias("ablation"), "correct", F.coalesce(F.size(words("context")), F.lit(0)).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.coalesce("retrieved_chunks", F.lit(0)).cast("long").alias("retrieved_chunks"), "retrieval_chars", "compressed_chars")
        counted = materialize(counted, "judged")
        part = counted.withColumn("retrieval_latency_ms", F.lit(spent).cast("long")).withColumn("latency_ms", F.lit(spent + each(since)).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def run_haystacks(cases: DataFrame, ablations: tuple[str, ...] = evaluate.ABLATIONS) -> DataFrame:
    """EVL1."""
    chunks = chunk_documents(cases, NIAH_CHUNK, "case_id", "haystack").select(F.col("id").alias("case_id"), F.col("position").alias("id"), "text")
    asked = cases.select("case_id", F.col("needle_key").alias("question"), F.array("needle_value").alias("accepted"))
    return run_all(chunks, asked, ablations)


def run_questions(entries: DataFrame, per_row: int | None = None, ablations: tuple[str, ...] = evaluate.ABLATIONS) -> DataFrame:
    """EVL3: ``entries(context, questions, answers)``; all questions, or the first ``per_row`` of each entry where the caller says so."""
    rows = materialize(entries.withColumn("row", F.monotonically_increasing_id()), "entries")
    asked = evaluate.first_questions(rows, per_row).select(F.concat_ws("-", "row", "pos").alias("case_id"), F.col("row").alias("corpus"), "question", "accepted")
    chunks = chunk_documents(rows, QUESTION_CHUNK, "row", "context").select(F.col("id").alias("corpus"), F.col("position").alias("id"), "text")
    return run_all(chunks, asked, ablations)


def run_session_file(entries: DataFrame, per_type: int, ablations: tuple[str, ...] = evaluate.ABLATIONS) -> DataFrame:
    """EVL2: entries of the session schema; each session is a chunk."""
    picked = evaluate.stratified_sample(entries, "question_id", "question_type", per_type)
    asked = picked.select(F.col("question_id").alias("case_id"), "question", F.array("answer").alias("accepted"))
    sessions = picked.select(F.col("question_id").alias("case_id"), F.posexplode("haystack_sessions").alias("id", "s"))
    lines = F.array_join(F.transform("s", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return run_all(sessions.select("case_id", "id", lines.alias("text")), asked, ablations)


def run_sessions(cases: DataFrame, chunks: DataFrame, k: int = HITS) -> DataFrame:
    """All cases against one shared corpus ``chunks(id, text)``, by BM25.

    The index keeps each shard's best ``k`` of a case only: what is shuffled grows with the cases, not with the pairs that share a token.
    """
    spark = cases.sparkSession
    index = PostingIndex.build(chunks, "id", "text", f"{shared_dir(spark)}/memlayer/sessions-{uuid.uuid4().hex}")
    hits = index.search(cases, "case_id", "question", k)
    texts = hits.withColumnRenamed("query_id", "case_id").join(chunks, "id")
    return evaluate.judged(evaluate.judge_text(texts), cases)
