"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash as its place in its source's order. A source takes all its documents as often as its target allows,
and of the rest those below a threshold: sizes are summed by source and hash bucket, the bucket in which the budget runs
out is found, and only that one is split again, until it holds one document. The document at the threshold is too large for what
is left, so the next threshold is sought among later and smaller ones, until what is left is a small part of the budget or
nothing fits. Which documents are taken follows from a comparison with these thresholds; documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
#: The search for further documents ends when what is left of a source's budget is at most one part in so many.
NEAR = 10_000
#: Bits of the hash that one histogram tells apart.
BITS = 12
HASH_BITS, ROW_BITS = 60, 63
#: Sources whose thresholds are broadcast, at most (a few hundred bytes each); with more of them they are joined.
LISTED_SOURCES = 50_000
WORD_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column | str) -> Column:
    """The number of runs of characters other than ASCII white space; null has none. Each word with the space around it
    becomes one letter, so no list of words is built."""
    c = F.col(text) if isinstance(text, str) else text
    short = F.regexp_replace(c, f"[{WORD_SPACE}]*+[^{WORD_SPACE}]++[{WORD_SPACE}]*+", "x")
    return F.when(c.rlike(f"[^{WORD_SPACE}]"), F.length(short)).otherwise(0).cast("long")


def hash_place(id_: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text: a document's place, the same in every run and layout."""
    whole = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= LISTED_SOURCES else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``sources(key, source, total)`` -> with ``target``: weights go round by the sources' code points, null last.

    What a source cannot hold (over ``ceiling`` times its total) is shared again among the others by weight: the common rate
    is raised until no open source exceeds its ceiling, a sum over the sources each time.
    """
    dealt = sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    placed = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "sources")
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a number for each partition
        offsets += [F.lit(part), F.lit(before)]
        before += n
    rank = F.col("row") + (F.coalesce(F.create_map(*offsets)[F.col("part")], F.lit(0)) if offsets else F.lit(0))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("most", F.col("total") * float(ceiling))
    all_, open_weight = placed.agg(F.sum("total"), F.sum("weight")).first()
    budget = share * (all_ or 0)
    rate, closed = budget / (open_weight or 1), -1
    while True:
        full = F.col("weight") * rate > F.col("most")
        held, rest, n = placed.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == closed or not rest:
            break
        rate, closed = (budget - (held or 0)) / rest, n
    return placed.select("key", "source", "total", F.least(F.col("weight") * rate, F.col("most")).alias("target"))


def _digits() -> list[Column]:
    """The bits of (hash, row) from the highest, in groups of ``BITS``."""
    out = []
    for name, bits in (("hash", HASH_BITS), ("row", ROW_BITS)):
        for low in range(bits - BITS, -BITS, -BITS):
            width = BITS + min(low, 0)
            out.append(F.shiftright(F.col(name), max(low, 0)).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def thresholds(sizes: DataFrame, budgets: DataFrame, near: int = NEAR) -> DataFrame:
    """``sizes(key, size, hash, row)``, ``budgets(key, budget)`` -> ``(key, cuts)``.

    A document is taken if one of its source's ``cuts`` (after, before, most) has its place strictly between and its size at most
    ``most``. They take what a walk in hash order would that takes each document that still fits.
    """
    here = F.struct("hash", "row")
    sources = budgets.count()
    done = None
    wall = F.struct(F.lit(-1).cast("long").alias("hash"), F.lit(-1).cast("long").alias("row"))
    now = budgets.where("budget > 0").select("key", "budget", F.col("budget").alias("left"), wall.alias("after"), F.array().cast("array<struct<after:struct<hash:long,row:long>,before:struct<hash:long,row:long>,most:long>>").alias("cuts"))
    now = materialize(now, "budgets")
    while not now.isEmpty():
        # the boundary bucket of each source: its bits so far, what is left before it
        at = now.select("key", F.col("left").alias("room"), "after", F.col("left").alias("most"), F.array().cast("array<long>").alias("bits"))
        found = None
        for depth, digit in enumerate(_digits()):
            prefix = F.lit(True)
            for i, d in enumerate(_digits()[:depth]):
                prefix = prefix & (d == F.col("bits")[i])
            met = sizes.join(_small(at, sources), "key").where((F.col("size") > 0) & (F.col("size") <= F.col("most")) & (here > F.col("after")) & prefix)
            cells = met.groupBy("key", digit.alias("digit")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"), F.min(here).alias("first"), F.first("room").alias("room"), F.first("after").alias("after"), F.first("most").alias("most"), F.first("bits").alias("bits"))
            # at most 2^BITS cells of a source meet here
            run = Window.partitionBy("key").orderBy("digit")
            over = cells.withColumn("upto", F.sum("sum").over(run)).where("upto > room and upto - sum <= room")
            over = materialize(over.select("key", (F.col("room") - F.col("upto") + F.col("sum")).alias("room"), "after", "most", F.concat("bits", F.array("digit")).alias("bits"), "n", "first"), "boundary")
            single = over.where("n = 1").select("key", F.col("room").alias("rest"), F.col("first").alias("stop"))
            found = single if found is None else found.union(single)
            at = over.where("n > 1").drop("n", "first")
            if at.isEmpty():
                break
        end = F.struct(F.lit((1 << 63) - 1).cast("long").alias("hash"), F.lit((1 << 63) - 1).cast("long").alias("row"))
        step = now.join(found, "key", "left").withColumn("cuts", F.concat("cuts", F.array(F.struct("after", F.coalesce("stop", end).alias("before"), F.col("left").alias("most")))))
        step = materialize(step, "cuts")
        open_ = F.col("stop").isNotNull() & (F.col("rest") * near > F.col("budget"))
        ended = step.where(~open_).select("key", "cuts")
        done = ended if done is None else done.union(ended)
        now = step.where(open_).select("key", "budget", F.col("rest").alias("left"), F.col("stop").alias("after"), "cuts")
    return done if done is not None else now.select("key", "cuts")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each document; ``taken`` counts repeats.

    A document is taken as often as its source's target holds the whole source, and once more if thresholds say so. A source's
    taken words never exceed its target; what is missing is at most a ten-thousandth of the part that is not whole, or less than any
    document left out. Null texts and texts of white space have size 0; a null source is a source of its own. Rows that are
    alike in all three columns are interchangeable, so which of them is taken shows nowhere. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    rows = docs.select(id_.alias("doc_id"), source.alias("source"), key.alias("key"), word_count(text).alias("size"), hash_place(id_, text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("total"))
    aims = materialize(targets(sources, weights, share, ceiling), "targets")
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    aims = aims.withColumn("whole", whole).withColumn("budget", (F.floor("target") - F.col("whole") * F.col("total")).cast("long"))
    cuts = materialize(thresholds(rows.select("key", "size", "hash", "row"), aims.select("key", "budget")), "thresholds")
    plan = materialize(aims.select("key", "total", "target", "whole").join(cuts, "key", "left"), "plan")
    here = F.struct("hash", "row")
    more = F.coalesce(F.exists("cuts", lambda c: (here > c["after"]) & (here < c["before"]) & (F.col("size") <= c["most"])), F.lit(False))
    out = rows.join(_small(plan, plan.count()), "key")
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * (F.col("whole") + more.cast("long"))).cast("long").alias("taken"))
