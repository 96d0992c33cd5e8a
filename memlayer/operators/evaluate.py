"""Evaluation: samples, judging, metrics and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlayer.functions.hashing import fnv1a
from memlayer.functions.text import JUDGE_SEPARATOR, contains_any

#: Question types of the session benchmark, in order, and its sample seed. Fixed values.
QUESTION_TYPES = ("single-session-user", "single-session-assistant", "single-session-preference", "multi-session", "temporal-reasoning", "knowledge-update")
SAMPLE_SEED = 0x4C4D455F4F5241
ABLATIONS = ("tier-0", "tier-0-1", "tier-0-1-2")


def stratified_sample(df: DataFrame, id_col: str, type_col: str, per_type: int, types: tuple[str, ...] = QUESTION_TYPES, seed: int = SAMPLE_SEED) -> DataFrame:
    """The first rows of each listed type by the seeded hash of their id, types in list order (WIN4); others are dropped.

    Adds ``type_rank`` and ``sample_rank``.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col(type_col))
    rows = df.where(F.col(type_col).isin(*types)).withColumn("type_rank", place.cast("int"))
    order = Window.partitionBy(type_col).orderBy(fnv1a(F.col(id_col).cast("string"), seed), F.col(id_col))
    return rows.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= per_type)


def first_questions(df: DataFrame, n: int | None, questions: str = "questions", answers: str = "answers") -> DataFrame:
    """The first ``n`` questions of each row, or all, that have answers (WIN5, FLT11): adds ``pos, question, accepted``."""
    pairs = F.slice(F.arrays_zip(F.col(questions).alias("q"), F.col(answers).alias("a")), 1, F.least(*([] if n is None else [F.lit(n)]), F.size(questions), F.size(answers)))
    rows = df.select("*", F.posexplode(pairs).alias("pos", "qa"))
    return rows.withColumn("question", F.col("qa.q")).withColumn("accepted", F.col("qa.a")).drop("qa").where(F.size("accepted") > 0)


def judge_text(hits: DataFrame, by: str = "case_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Retrieved texts of a case in rank order with a separator between them (AGG14, JN11)."""
    rows = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))).alias("h"))
    return rows.select(by, F.array_join(F.transform("h", lambda h: h["t"]), JUDGE_SEPARATOR).alias("context"))


def judged(contexts: DataFrame, cases: DataFrame, by: str = "case_id", accepted: str = "accepted") -> DataFrame:
    """Whether any accepted answer is in the context; a case without hits is wrong."""
    return cases.join(contexts, by, "left").withColumn("correct", contains_any(F.coalesce("context", F.lit("")), accepted))


def metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Totals, right ones, mean latency and accuracy (AGG6); no case gives zeros."""
    total = F.count(F.lit(1))
    right = F.count_if("correct")
    return cases.groupBy(*by).agg(total.alias("total"), right.alias("correct"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"), F.when(total > 0, right / total).otherwise(0.0).alias("accuracy"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases ``(ablation, case_id)`` that passed before and pass no longer, removed ones included (SET2, JN10)."""
    passed = lambda df: df.where("correct").select("ablation", "case_id")
    return passed(baseline).exceptAll(passed(current))


def snapshot_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(ablation, before, now, delta)``: passing cases of two snapshots (AGG12); a configuration in one of them only counts 0 in the other."""
    passed = lambda df, name: df.groupBy("ablation").agg(F.count_if("correct").alias(name))
    both = passed(baseline, "before").join(passed(current, "now"), "ablation", "full")
    both = both.select("ablation", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "now")])
    return both.withColumn("delta", F.col("now") - F.col("before"))


def ablation_matrix(cases: DataFrame, ablations: tuple[str, ...] = ABLATIONS) -> DataFrame:
    """Every case under every configuration (EVL4)."""
    return cases.withColumn("ablation", F.explode(F.array(*[F.lit(a) for a in ablations])))
