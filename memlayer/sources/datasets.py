"""Dataset sources: session and question files, labelled queries, generated haystacks, and report sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from memlayer.functions.hashing import fnv1a_int
from memlayer.sources import schema
from memlayer.sources.steps import materialize

#: Generated haystack: words, needle sentence, sizes and seed. Fixed values.
FILLER = (
    "the of and to in is for with as by are was were be ai system memory long context language model evaluation benchmark "
    "retrieval agent task data training inference prompt token vector embedding store database query index score rank "
    "compress summarize session chunk fact pending decision review write read save load"
).split()
NEEDLE = "The magic key {key} has the special value {value}. Remember this fact."
SIZES = (2048, 4096, 8192, 12288)
HAYSTACK_SEED = 0x52554C4552


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file of session questions (SRC8); a number or boolean answer is read as its text (SF8)."""
    return spark.read.schema(schema.SESSIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: every line with its number in its file, from 1, blank ones too.

    Files are read in splits by byte ranges. Each task counts the lines of its splits; the counts of a file's earlier splits,
    a row each, are added to the number within the split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    kind = "value string, file string, start long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            numbers = []
            for split in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = n + 1 if split == now else 1
                now = split
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["value", "file", "start", "n"])

    lines = materialize(lines.mapInArrow(count, kind), "lines")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "start").agg(F.max("n").alias("lines"))
    before = splits.select("file", "start", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    return lines.join(before, ["file", "start"]).select("file", (F.col("n") + F.col("before")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, and the error for a malformed line names its file and number.

    The number is sought only when there is such a line: a first pass looks for one and stops at it.
    """
    fields = StructType.fromDDL(kind)
    read = lambda lines: lines.withColumn("r", F.from_json("value", StructType([*fields.fields, StructField("_bad", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    filled = F.trim(F.regexp_replace("value", "\\s", " ")) != ""
    lines = spark.read.text(path).where(filled)
    if not read(lines).where("r._bad is not null").limit(1).isEmpty():
        bad = read(numbered_lines(spark, path).where(filled)).where("r._bad is not null").orderBy("file", "line").first()
        raise ValueError(f"malformed line {bad.line} of {bad.file}: {bad.value[:200]}")
    return read(lines).select(*[F.col("r")[f.name].alias(f.name) for f in fields])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file of contexts with questions (SRC9); blank lines are skipped, a malformed line is an error with its number."""
    return read_json_lines(spark, path, schema.QUESTIONS)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries (SRC12)."""
    return spark.read.schema(schema.LABELLED).option("mode", "FAILFAST").json(path)


def parquet_to_json_lines(spark: SparkSession, source: str, target: str) -> int:
    """Convert and compare the number of rows read back (SRC10)."""
    df = spark.read.parquet(source)
    df.write.mode("overwrite").json(target)
    n = df.count()
    if spark.read.schema(df.schema).json(target).count() != n:
        raise ValueError("rows were lost in conversion")
    return n


def _advance(state: int) -> int:
    state ^= state << 13 & (1 << 64) - 1
    state ^= state >> 7
    return state ^ state << 17 & (1 << 64) - 1


def haystack(case: int, size: int, seed: int = HAYSTACK_SEED) -> tuple[str, int, str, str, str]:
    """One needle-in-a-haystack case: (case_id, seq_len, haystack, key, value) (SF20)."""
    own = fnv1a_int(f"niah-{size}".encode(), seed ^ case)
    key, value = (f"{fnv1a_int(n, own) & 0xFFFFFFFF:08x}" for n in (b"key", b"value"))
    picked, length, state = [], 0, own
    while length < size * 4:
        state = _advance(state)
        word = FILLER[state % len(FILLER)]
        length += len(word) + bool(picked)
        picked.append(word)
    text = " ".join(picked)
    at = text.rfind(" ", 0, own % max(len(text), 1)) + 1
    needle = NEEDLE.replace("{key}", key).replace("{value}", value)
    return f"niah-{size // 1024}k", size, f"{text[:at]}{needle} {text[at:]}", key, value


def haystacks(spark: SparkSession, sizes: tuple[int, ...] = SIZES, seed: int = HAYSTACK_SEED) -> DataFrame:
    """``(case_id, seq_len, haystack, needle_key, needle_value)`` (SRC11)."""
    rows = [haystack(i, n, seed) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "case_id string, seq_len int, haystack string, needle_key string, needle_value string")


def write_cases(cases: DataFrame, path: str) -> None:
    """JSON lines by bench and ablation, null fields left out (SNK1, SNK4)."""
    cases.write.mode("overwrite").partitionBy("bench", "ablation").json(path)


class CaseWriter:
    """Cases of one bench and configuration, added as they finish (SNK3).

    ``create`` empties what an earlier run left; each ``write`` adds files that appear whole or not at all; ``finish`` gives the
    section's metrics over all that was written.
    """

    def __init__(self, spark: SparkSession, path: str, bench: str, ablation: str) -> None:
        self.spark, self.path, self.schema = spark, f"{path}/{bench}/{ablation}", schema.CASE

    @classmethod
    def create(cls, spark: SparkSession, path: str, bench: str, ablation: str) -> CaseWriter:
        writer = cls(spark, path, bench, ablation)
        spark.createDataFrame([], writer.schema).write.mode("overwrite").json(writer.path)
        return writer

    def write(self, cases: DataFrame) -> None:
        cases.write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.path)

    def finish(self) -> DataFrame:
        from memlayer.operators.evaluate import metrics

        return metrics(self.read())


def sections(cases: DataFrame) -> DataFrame:
    """``(bench, ablation, aggregate, cases)``: a row for each section of a report (SNK2)."""
    from memlayer.operators.evaluate import metrics

    fields = [c for c in cases.columns if c not in ("bench", "ablation")]
    each = cases.groupBy("bench", "ablation").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cases"))
    totals = metrics(cases, "bench", "ablation").select("bench", "ablation", F.struct("total", "correct", "mean_latency_ms", "accuracy").alias("aggregate"))
    return totals.join(each, ["bench", "ablation"])


def summary(cases: DataFrame, suite: str) -> DataFrame:
    """One JSON document of the whole suite (SNK2), for suites of a size that one document may have.

    The report's form is one value; :func:`write_summary` writes a document for each section instead, in parallel.
    """
    rows = sections(cases).agg(F.array_sort(F.collect_list(F.struct("bench", "ablation", "aggregate", "cases"))).alias("sections"))
    return rows.select(F.to_json(F.struct(F.lit(suite).alias("suite"), "sections")).alias("value"))


def write_summary(cases: DataFrame, suite: str, path: str) -> None:
    """A line of JSON for each section, with the suite's name; sections are written where they were aggregated."""
    sections(cases).select(F.to_json(F.struct(F.lit(suite).alias("suite"), "bench", "ablation", "aggregate", "cases")).alias("value")).write.mode("overwrite").text(path)
