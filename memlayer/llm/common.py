"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlayer.sources.steps import discard, materialize

__all__ = ["discard", "materialize", "paired_blocks", "table", "training_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(doc_id: Column | str) -> Column:
    """True for rows a model may learn from: crc32(id as text) mod 4 is not 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4 != 2


#: Large groups that are named in a broadcast, at most (a key and a number each); with more of them they are joined.
LISTED_GROUPS = 100_000


def paired_blocks(df: DataFrame, by: list[str], item: str, block: int) -> DataFrame:
    """Split large groups into pairs of blocks, so that no task holds a whole group.

    ``df`` is keyed by ``by`` (never null) and read twice. A group of up to ``block`` rows stays as it is (part 0, 0). A larger
    one is dealt into ``n = ceil(2 * size / block)`` blocks by a hash of ``item`` and every block meets every other one, so each
    pair of rows shares a part (``_i``, ``_j``) of about ``block`` rows. All pairs stay covered; nothing is dropped. ``_own``
    is the block a row was dealt to: a pair within one block meets in several parts. Sizes are counted by partial
    aggregation, so a hot group never passes one task whole.
    """
    large = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "large-groups")
    known = large.limit(LISTED_GROUPS + 1).count()
    if not known:
        zero = F.lit(0)
        return df.select("*", zero.alias("_own"), zero.alias("_i"), zero.alias("_j"))
    df = df.join(F.broadcast(large) if known <= LISTED_GROUPS else large, by, "left")
    blocks = F.coalesce(F.ceil(2 * F.col("_n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit(7)), F.col("_b")).cast("int")
    df = df.withColumn("_b", blocks).withColumn("_own", own)
    other = F.explode(F.when(F.col("_b") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_b") - 1)))
    # with more than one block, the part (b, b) is covered by every part (b, x)
    df = df.withColumn("_o", other).where("_b = 1 or _o <> _own")
    return df.withColumn("_i", F.least("_own", "_o")).withColumn("_j", F.greatest("_own", "_o")).drop("_b", "_o", "_n")
