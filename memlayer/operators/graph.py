"""Closures over parents, successors and precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlayer.sources.steps import discard, materialize


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All ``(id, ancestor, depth)`` along edges, each pair once at its least depth (JN7-9).

    Paths double in each round, so a chain of n edges takes log2(n) joins; the loop ends when a round adds no pair, so there is
    no limit on depth and a cycle ends (its members are their own ancestors). A round's pairs are written to the shared folder.
    The closure of a chain of n edges holds n (n + 1) / 2 pairs: that is its size, use :func:`chain` for given starts.
    """
    rows = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("id"), F.col(dst).alias("ancestor"))
    if (found := _closure_of_chains(rows)) is not None:
        return found
    once = rows.distinct()
    known = materialize(once.withColumn("depth", F.lit(1)), "closure")
    size = known.count()
    while size:
        far = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("to"), F.col("depth").alias("more"))
        longer = known.join(far, "ancestor").select("id", F.col("to").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        following = materialize(known.union(longer).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        count = following.count()
        discard(known)
        known = following
        if count == size:
            return known
        size = count
    return known


def _closure_of_chains(rows: DataFrame) -> DataFrame | None:
    """The closure where no id has two edges and none leads back to itself; None for other graphs.

    There only one way leads from an id to an ancestor. A round adds the pairs farther than those known: jumps of the greatest
    known depth, followed by each known pair. So no pair is formed, compared or written twice.
    """
    least = materialize(rows.groupBy("id").agg(F.min("ancestor").alias("ancestor"), F.max("ancestor").alias("most")), "closure")
    jump = least.select("id", "ancestor", F.lit(1).alias("depth"))
    if not least.where("ancestor <> most or id = ancestor").limit(1).isEmpty():
        discard(least)
        return None
    known, reach, parts = jump, 1, [least]
    while not jump.limit(1).isEmpty():
        far = known.select(F.col("id").alias("by"), F.col("ancestor").alias("to"), F.col("depth").alias("more"))
        longer = jump.select("id", F.col("ancestor").alias("by")).join(far, "by").select("id", F.col("to").alias("ancestor"), (F.col("more") + reach).alias("depth"))
        parts.append(materialize(longer, "closure"))
        if not parts[-1].where("id = ancestor").limit(1).isEmpty():
            for part in parts:
                discard(part)
            return None
        known, reach = known.union(parts[-1]), 2 * reach
        jump = parts[-1].where(F.col("depth") == reach)
    return known


def chain(nodes: DataFrame, id_col: str, parent_col: str, start: DataFrame) -> DataFrame:
    """``(start, id, depth)`` from each start upwards, the start at depth 0, stopping at a missing node (CTX2).

    Jumps double as in :func:`closure`: each round every node learns the ancestor twice as far up, and each reached node takes its
    jump, so a path of n levels takes log2(n) rounds. A node met again ends its chain: it is listed at its least depth.
    """
    one = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    jump = materialize(one.join(one.select(F.col("id").alias("parent")), "parent").select("id", F.col("parent").alias("up")), "jump")
    begun = start.select(F.col(start.columns[0]).alias("start")).distinct()
    known = materialize(begun.join(one, F.col("start") == F.col("id")).select("start", "id", F.lit(0).cast("long").alias("depth")), "chain")
    size, step = known.count(), 1
    while size:
        further = known.join(jump, "id").select("start", F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        following = materialize(known.union(further).groupBy("start", "id").agg(F.min("depth").alias("depth")), "chain")
        count = following.count()
        discard(known)
        known = following
        if count == size:
            break
        size, step = count, 2 * step
        twice = materialize(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "jump")
        discard(jump)
        jump = twice
    return known.select("start", "id", F.col("depth").cast("int").alias("depth"))


def chain_fixed(nodes: DataFrame, id_col: str, parent_col: str, start: DataFrame, levels: int) -> DataFrame:
    """As :func:`chain` for a hierarchy of known height, as one lazy plan."""
    known = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    level = start.select(F.col(start.columns[0]).alias("start")).distinct().join(known, F.col("start") == F.col("id")).select("start", "id", "parent")
    out = level.select("start", "id", F.lit(0).alias("depth"))
    for depth in range(1, levels):
        level = level.select("start", F.col("parent").alias("id")).where("id is not null").join(known, "id").select("start", "id", "parent")
        out = out.union(level.select("start", "id", F.lit(depth).alias("depth")))
    return out


def forest_labels(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``(id, root, first, last, size)`` for every node of a forest: ``a`` is ``b`` or above it if their roots are equal and
    ``a.first <= b.first <= a.last`` (JN7-9).

    The numbers are places in a walk around each tree that enters and leaves each node once. Its steps are a linked list, and each
    step learns its distance to the end by pointer jumping: a round doubles how far all steps see, so a chain of n nodes
    takes log2(2n) joins of 2n rows, and no pair of nodes is ever written. First each node learns its root and depth in the same way;
    trees without a fork need no walk. A parent that is missing makes a root. Nodes on a
    cycle, or below one, have no root: their labels are null. Of rows that repeat an id the least parent
    counts. ``size`` is the number of nodes from it downwards.
    """
    one = nodes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(parent_col).alias("parent"))
    one = materialize(one, "nodes")
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    to = F.when(F.col("there"), F.col("parent"))
    up = one.join(known, "parent", "left").select("id", to.alias("to"), F.when(to.isNull(), 0).otherwise(1).cast("long").alias("far"), F.when(to.isNull(), F.col("id")).alias("root"))
    up = _jumped(materialize(up, "up"), "id", one.count())
    # a tree with as many nodes as levels is a path: its labels follow from the depth
    trees = up.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n"), (F.max("far") + 1).alias("levels"))
    placed = materialize(up.join(trees, "root", "left").select("id", "root", F.col("far").alias("depth"), "n", "levels"), "placed")
    first, last = F.col("depth"), 2 * F.col("n") - 1 - F.col("depth")
    none = F.lit(None).cast("long")
    of = lambda c: F.when(F.col("root").isNotNull(), c).otherwise(none)
    out = placed.where("root is null or n = levels").select("id", "root", of(first).alias("first"), of(last).alias("last"), of(F.col("n") - F.col("depth")).alias("size"))
    forked = placed.where("n > levels")
    if forked.limit(1).isEmpty():
        return out
    one = one.join(forked.select("id", "depth"), "id").select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"))
    return out.union(_walk_labels(materialize(one, "forked")))


def _jumped(rows: DataFrame, at: str, count: int) -> DataFrame:
    """``(at, to, far, root)`` with ``to`` followed to the end by pointer jumping: each round doubles how far all rows see."""
    for _ in range(max(1, count.bit_length())):
        ahead = rows.select(F.col(at).alias("to"), F.col("to").alias("then"), F.col("far").alias("more"), F.col("root").alias("end"))
        following = materialize(rows.join(ahead, "to", "left").select(at, F.col("then").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("root", "end").alias("root")), "jumped")
        discard(rows)
        rows = following
        if rows.where("to is not null").limit(1).isEmpty():
            break
    return rows


def _walk_labels(one: DataFrame) -> DataFrame:
    """The labels of trees ``(id, parent)`` from a walk around each."""
    siblings = Window.partitionBy("parent").orderBy("id")
    below = one.where("parent is not null").select("id", "parent", F.lead("id").over(siblings).alias("next"), F.row_number().over(siblings).alias("n"))
    first_child = below.where("n = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    step = lambda id_, leaves: F.struct(id_.alias("id"), F.lit(leaves).alias("leaves"))
    entered = one.join(first_child, "id", "left").select(step(F.col("id"), False).alias("at"), F.when(F.col("child").isNull(), step(F.col("id"), True)).otherwise(step(F.col("child"), False)).alias("to"))
    left = one.join(below.select("id", "next"), "id", "left").select(step(F.col("id"), True).alias("at"), F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("parent").isNotNull(), step(F.col("parent"), True)).alias("to"))
    # the last step of a tree points nowhere and knows its root
    walk = entered.union(left).select("at", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far"), F.when(F.col("to").isNull(), F.col("at.id")).alias("root"))
    walk = _jumped(materialize(walk, "walk"), "at", 2 * one.count())
    ends = walk.where("root is not null").groupBy("at.id").agg(F.first("root").alias("root"), F.max("far").alias("enter"), F.min("far").alias("leave"))
    length = ends.where("id = root").select("root", F.col("enter").alias("length"))
    placed = ends.join(length, "root").select("id", "root", (F.col("length") - F.col("enter")).alias("first"), (F.col("length") - F.col("leave")).alias("last"))
    size = (F.col("last") - F.col("first") + 1) / 2
    return one.select("id").join(placed, "id", "left").select("id", "root", "first", "last", size.cast("long").alias("size"))


class Reach:
    """Answers "does ``a`` lead to ``b``" along edges from labels, without a closure (JN8, JN9).

    Each node's least edge is its place in a forest; the other edges are exceptions, kept apart. A pair is settled by the
    labels, or by a way over exceptions: those lead to one another if labels say so, and their closure alone is written. Nodes on
    a cycle of least edges are not supported: that is an error.
    """

    def __init__(self, edges: DataFrame, src: str, dst: str) -> None:
        rows = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct(), "edges")
        both = materialize(rows.groupBy("s").agg(F.min("d").alias("d"), F.max("d").alias("most")), "least")
        tree = both.select("s", "d")
        nodes = tree.union(rows.select(F.col("d").alias("s"), F.lit(None).cast(rows.schema["d"].dataType).alias("d")))
        self.labels = materialize(forest_labels(nodes, "s", "d"), "labels")
        if not self.labels.where("root is null").limit(1).isEmpty():
            raise ValueError("the least edges form a cycle")
        forks = both.where("d <> most").select("s", F.col("d").alias("least"))
        rest = materialize(rows.join(forks, "s").where("d <> least").select("s", "d"), "exceptions")
        at = lambda c, p: self.labels.select(F.col("id").alias(c), F.col("root").alias(f"{p}_root"), F.col("first").alias(f"{p}_first"), F.col("last").alias(f"{p}_last"))
        ways = materialize(rest.join(at("s", "s"), "s").join(at("d", "d"), "d"), "exceptions")
        self.few = ways.count()
        if self.few:
            first, then = ways.select("s", "d", "d_root", "d_first"), ways.select(F.col("s").alias("s2"), F.col("d").alias("d2"), "s_root", "s_first", "s_last")
            joined = first.join(then, F.col("d_root") == F.col("s_root")).where("d_first between s_first and s_last")
            links = joined.select(F.struct("s", "d").alias("a"), F.struct(F.col("s2").alias("s"), F.col("d2").alias("d")).alias("b"))
            steps = closure(links, "a", "b").select(F.col("id").alias("a"), F.col("ancestor").alias("b"))
            own = ways.select(F.struct("s", "d").alias("a"), F.struct("s", "d").alias("b"))
            both = materialize(own.union(steps).distinct().select("a.s", "b.d").distinct(), "ways")
            self.ways = materialize(both.join(at("s", "s"), "s").join(at("d", "d"), "d"), "ways")

    def pairs(self, asked: DataFrame, a: str, b: str) -> DataFrame:
        """The rows of ``asked`` with ``reached``: whether ``a`` leads to ``b`` by one edge or more; unknown nodes lead nowhere."""
        at = lambda c, p: self.labels.select(F.col("id").alias(c), F.col("root").alias(f"{p}_r"), F.col("first").alias(f"{p}_f"), F.col("last").alias(f"{p}_l"))
        if not self.few:
            named = asked.join(at(a, "a"), a, "left").join(at(b, "b"), b, "left")
            reached = (F.col(a) != F.col(b)) & (F.col("a_r") == F.col("b_r")) & F.col("a_f").between(F.col("b_f"), F.col("b_l"))
            return named.select(*[F.col(c) for c in asked.columns], F.coalesce(reached, F.lit(False)).alias("reached"))
        known = asked.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().join(at("a", "a"), "a").join(at("b", "b"), "b")
        found = known.where("a <> b and a_r = b_r and a_f between b_f and b_l").select("a", "b")
        if self.few:
            way = known.join(self.ways, F.col("a_r") == F.col("s_root")).where("a_f between s_first and s_last and d_root = b_r and d_first between b_f and b_l")
            found = found.union(way.select("a", "b")).distinct()
        return asked.join(found.select(F.col("a").alias(a), F.col("b").alias(b), F.lit(True).alias("reached")), [a, b], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
