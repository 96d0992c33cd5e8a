"""Integrity checks of stored entities; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlayer.operators.graph import closure


def summary_violation(level: str = "summary_level", method: str = "summary_method", children: str = "children") -> Column:
    """The first rule that a chunk's summary fields break, or null (FLT10). The three messages."""
    leaf = F.col(level) == 0
    return (
        F.when(leaf & (F.col(method) != "None"), F.lit("raw leaf (summary_level = 0) must have SummaryMethod::None"))
        .when(~leaf & (F.coalesce(F.size(children), F.lit(0)) <= 0), F.lit("summary node (summary_level > 0) must have children"))
        .when(~leaf & (F.col(method) == "None"), F.lit("summary node must have a non-None SummaryMethod"))
    )


def is_raw_leaf(level: str = "summary_level") -> Column:
    """FLT1."""
    return F.col(level) == 0


def is_summary_node(level: str = "summary_level") -> Column:
    return F.col(level) > 0


def has_method(method: str = "summary_method") -> Column:
    """FLT9."""
    return F.col(method) != "None"


def unmatched_links(chunks: DataFrame) -> DataFrame:
    """(parent, child) pairs stated on one side only."""
    up = chunks.where("parent is not null").select(F.col("parent"), F.col("id").alias("child"), F.lit(True).alias("up"))
    down = chunks.select(F.col("id").alias("parent"), F.explode("children").alias("child")).withColumn("down", F.lit(True))
    return up.join(down, ["parent", "child"], "full").where("up is null or down is null").select("parent", "child", F.coalesce("up", F.lit(False)).alias("by_child"))


def cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Ids that reach themselves."""
    return closure(edges, src, dst).where("id = ancestor").select("id")


def levels_not_falling(chunks: DataFrame) -> DataFrame:
    """Children whose level is not below their parent's."""
    parents = chunks.select(F.col("id").alias("p"), F.col("summary_level").alias("above"))
    return chunks.join(parents, chunks.parent == F.col("p")).where("summary_level >= above").select("id", "parent")


def unlisted_pending(pending: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pending items that their introducing chunk does not list."""
    listed = chunks.select(F.col("id").alias("introduced_at"), F.explode("pending").alias("id"))
    return pending.join(listed, ["introduced_at", "id"], "left_anti").select("id", "introduced_at")


def not_transitive(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, ancestor) pairs that the relation implies in two steps and does not hold."""
    pairs = edges.select(F.col(src).alias("id"), F.col(dst).alias("mid")).distinct()
    two = pairs.join(edges.select(F.col(src).alias("mid"), F.col(dst).alias("ancestor")).distinct(), "mid").select("id", "ancestor").distinct()
    return two.join(pairs.select("id", F.col("mid").alias("ancestor")), ["id", "ancestor"], "left_anti")


def resolved_before(pending: DataFrame, happens_before: DataFrame, column: str = "resolved_at") -> DataFrame:
    """Items whose resolution is neither where they began nor after it; ``happens_before(src, dst)`` is transitive."""
    named = pending.where(F.col(column).isNotNull() & (F.col(column) != F.col("introduced_at")))
    after = happens_before.select(F.col("src").alias("introduced_at"), F.col("dst").alias(column)).distinct()
    return named.join(after, ["introduced_at", column], "left_anti").select("id")


def leaves_without_items(chunks: DataFrame) -> DataFrame:
    """Raw leaves without items (an optional rule)."""
    return chunks.where("summary_level = 0 and coalesce(size(items), 0) <= 0").select("id")
