"""Near copies by exact Jaccard similarity of word shingles: SimHash by covering masks, with MinHash for what it cannot see.

Candidates come from the SimHash operator (fingerprints of the shingle sets, every pair within 3 of 64 bits) and from MinHash:
``BANDS`` keys of ``ROWS`` minima each. At a similarity of 0.8 two SimHash fingerprints differ in about ten bits, so covering
masks alone would find one pair in a hundred there; a pair of similarity s meets by MinHash with
probability 1 - (1 - s^ROWS)^BANDS (0.9999 at 0.8). A met pair is linked only if its exact similarity reaches the
threshold.

In a bucket one member is compared with all that no link connects to it so far, and leaves; nobody leaves uncompared. A group
of copies is connected by one such round, and a bucket whose members are all connected is done. What is left after ``ROUNDS``
rounds meets in pairs of blocks, whose tasks compare what is not connected yet and write links only. A large bucket with
few members outside one component compares only those with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import discard, materialize, paired_blocks
from memlayer.llm.components import components, stars
from memlayer.llm.simhash import bits_of, near_links

WORDS = 5
LEAST = 0.8
BANDS = 30
ROWS = 6
ROUNDS = 3
#: Members of a bucket that meet in one task, and comparisons with one member that share a copy of its text.
BLOCK = 128


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    join, digest = b" ".join, xxhash.xxh64_intdigest
    count = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((digest(join(parts[i : i + words])) for i in range(count)), np.uint64, count))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hash of the shingle set, its SimHash fingerprint, then a key for each band, as signed longs."""
    r = np.random.default_rng(42)
    mix, times = r.integers(0, 1 << 63, BANDS * ROWS, np.uint64), r.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    h = shingles(text, words)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1024):
        low = np.minimum(low, ((h[at : at + 1024, None] ^ mix) * times).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array([xxhash.xxh64_intdigest(h.tobytes()), bits_of(h), *keys], np.uint64).view(np.int64)


def _linked(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity is at least ``least``; a text asked for often is dealt out in copies."""
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    ones = often.join(texts, often.a == texts.node).select("a", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "n")
    dealt = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"))
    met = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(ones.drop("n"), ["a", "part"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, one = a, shingles(ta.as_py(), words)
                good.append(similarity(one, shingles(tb.as_py(), words)) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def buckets(keys: DataFrame) -> DataFrame:
    """``keys(node, keys)``, one row a node -> ``(node, key)`` of the buckets that hold more than one node."""
    met = keys.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return materialize(met.join(shared, "key"), "buckets")


def covered(fingerprints: DataFrame) -> DataFrame:
    """``fingerprints(node, fp)`` -> pairs ``(a, b)`` of a node and the least one of its group under the covering masks.

    One pair a node, however large a group is; what lies far from its group's least node is left to MinHash.
    """
    alike = fingerprints.groupBy("fp").agg(F.min("node").alias("first"))
    groups = stars(near_links(alike.select(F.col("first").alias("node"), "fp")))
    least = alike.join(groups, alike["first"] == groups.id, "left").select("fp", F.coalesce("component", "first").alias("a"))
    return materialize(fingerprints.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b")), "pairs")


def _labelled(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``met(key, node)`` with the component of each node, itself where no link names it."""
    if groups is None:
        return met.select("key", "node", F.col("node").alias("component"))
    return met.select("key", "node").join(groups, F.col("node") == groups.id, "left").select("key", "node", F.coalesce("component", "node").alias("component"))


def _unlike(met: DataFrame, turn: int = 0) -> DataFrame:
    """``(key, a, of, n)``: the buckets whose members are not all connected, their size, and the member that is compared next:
    the least one, which many buckets share, and later another in each turn."""
    order = F.struct(*([F.xxhash64("node", F.lit(turn)).alias("h")] if turn else []), "node", "component")
    each = met.groupBy("key").agg(F.min(order).alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    return each.where("lo < hi").select("key", F.col("first.node").alias("a"), F.col("first.component").alias("of"), "n")


def block_links(met: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Links ``(a, b)`` of the buckets ``met(key, node, component)``, in pairs of blocks; connected members are not compared.

    Of parts with the same members one is looked at. A task reads its parts one after the other.
    """
    part = ["key", "_i", "_j"]
    dealt = materialize(paired_blocks(met.join(_unlike(met).select("key"), "key"), ["key"], "node", BLOCK).select(*part, "node", "component"), "blocks")
    same = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("t"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    once = same.where("lo < hi").groupBy("n", "s", "t").agg(F.min(F.struct(*part)).alias("p")).select("p.*")
    full = dealt.join(once, part, "left_semi").join(texts, "node").select(*part, "node", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *key, node, component, text in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5), strict=True):
                if key != now:
                    out += spanning(members, least)
                    now, members = key, []
                members.append((node, component, shingles(text.as_py(), words)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        if out := spanning(members, least):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    dealt = full.repartition(*part).sortWithinPartitions(*part)
    return materialize(dealt.mapInArrow(run, "a long, b long"), "links")


def spanning(members: list[tuple[int, int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs of ``(node, component, hashes)`` connect; pairs in one component are skipped."""
    label = [c for _, c, _ in members]
    out = []
    for i, (a, _, x) in enumerate(members):
        for j in range(i):
            b, _, y = members[j]
            if label[i] != label[j] and min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least:
                out.append((a, b))
                old, new = label[j], label[i]
                label = [new if c == old else c for c in label]
    return out


def links(met: DataFrame, texts: DataFrame, known: DataFrame | None = None, least: float = LEAST, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """``met(node, key)``, ``texts(node, text)``, one row a node -> links that connect what all similar met pairs connect.

    ``known``: links to start from. A star's members are compared with its centre, which then leaves the bucket; members that
    are connected to it, directly or not, need no comparison, but stay until they were compared with the others or are
    connected to all of them. The first round treats all buckets, the others those of over ``BLOCK`` members.
    """
    found, grouped = known, None

    def star(met: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """The buckets without their centres, with their sizes, and the links to these."""
        around = materialize(met.join(_unlike(met, turn), "key").where("node <> a"), "stars")
        return around, materialize(_linked(around.where("component <> of").select("a", F.col("node").alias("b")).distinct(), texts, least, words), "links")

    def add(good: DataFrame) -> None:
        nonlocal found, grouped
        if not good.isEmpty():
            found, grouped = good if found is None else found.union(good), None

    def groups() -> DataFrame | None:
        """The components of all links so far, whose stars then stand for these links."""
        nonlocal found, grouped
        if grouped is None and found is not None:
            grouped = stars(found)
            found = grouped.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return grouped

    first = materialize(_labelled(met, groups()), "labelled")
    around, good = star(first, 0)
    discard(first)
    add(good)
    big = materialize(_labelled(around.where(F.col("n") > BLOCK), groups()), "labelled")
    for turn in range(1, rounds):
        if big.isEmpty():
            break
        left, good = star(big, turn)
        discard(big)
        if good.isEmpty():
            big = left.select("key", "node", "component")
            continue
        add(good)
        # what is new joins components, of which there are few
        label = lambda c, of: left.select(F.col("node").alias(c), F.col("component").alias(of)).union(left.select("a", "of")).distinct()
        merged = stars(good.join(label("a", "ca"), "a").join(label("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        big = materialize(left.join(merged, left.component == merged.id, "left").select("key", "node", F.coalesce(merged.component, left.component).alias("component")), "labelled")
        discard(left)
    if not big.isEmpty():
        few = materialize(_few(big), "few")
        if not few.where(F.col("rest") <= FEW).isEmpty():
            add(straggler_links(big, few.where(F.col("rest") <= FEW), texts, least, words))
        if not (many := few.where(F.col("rest") > FEW)).isEmpty():
            add(block_links(_labelled(big.join(many.select("key"), "key"), groups()), texts, least, words))
        discard(few)
    discard(big)
    small = materialize(_labelled(around.where(F.col("n") <= BLOCK), groups()), "labelled")
    discard(around)
    add(block_links(small, texts, least, words))
    discard(small)
    return good if found is None else found


#: Members outside a bucket's largest component that are each compared with all others; with more of them blocks meet.
FEW = 1024


def _few(met: DataFrame) -> DataFrame:
    """``(key, most, rest)``: each unconnected bucket's largest component and how many members lie outside it."""
    each = met.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"))
    return most.select("key", F.col("m.component").alias("most"), (F.col("n") - F.col("m.n")).alias("rest")).where("rest > 0")


def straggler_links(met: DataFrame, few: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Links of those buckets of ``met(key, node, component)`` that ``few`` names, connected but for ``FEW`` members: those meet
    all others.

    The members of a bucket's largest component are dealt out once, whatever the number of buckets that hold them, in blocks
    to which each straggler comes; it is compared with those that share a bucket with it. In the first block the stragglers
    meet one another as well.
    """
    named = materialize(met.join(few, "key"), "stragglers")
    single = named.where("component <> most")
    lone = single.groupBy("most", "node").agg(F.first("component").alias("component"), F.collect_set("key").alias("keys"))
    whole = named.where("component = most").groupBy("most", "node").agg(F.first("component").alias("component"), F.collect_set("key").alias("keys"))
    blocks = whole.groupBy("most").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("blocks"))
    dealt = whole.join(blocks, "most").select("most", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "node", "component", "keys")
    dealt = dealt.union(lone.join(blocks, "most").select("most", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0), "node", "component", "keys"))
    full = dealt.join(texts, "node").select("most", "block", "side", "node", "component", "keys", "text").repartition("most", "block").sortWithinPartitions("most", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            a, b = [], []
            for most, block, side, node, component, keys, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (most, block) != now:
                    now, held = (most, block), []
                own = shingles(text, words)
                if side == 1 or block == 0:
                    for other, whose, theirs, set_ in held:
                        near = whose != component and min(len(own), len(set_)) >= least * max(len(own), len(set_))
                        if near and not theirs.isdisjoint(keys) and similarity(own, set_) >= least:
                            a.append(other)
                            b.append(node)
                if side == 0:
                    held.append((node, component, frozenset(keys), own))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = materialize(full.mapInArrow(run, "a long, b long"), "links")
    discard(named)
    return found


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, words: int = WORDS) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, then the smallest hash of its text.

    Rows that share an id but not their text are judged each by its text. A row without an id stays as it is. Null and
    empty texts are copies of each other. The columns of ``docs`` may have any names. An empty table gives an empty result.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text at a time: neither a list of texts nor rows that wait for their sketch are held
        for batch in batches:
            flat = np.concatenate([np.zeros(0, np.int64), *[sketch(t.as_py(), words) for t in batch.column(2)]])
            ends = np.arange(len(batch) + 1, dtype=np.int32) * (2 + BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], names=["i", "t", "s"])

    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(id_.isNotNull()).select(id_.alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    keys = rows.mapInArrow(sketches, f"i {docs.schema[id_col].dataType.simpleString()}, t long, s array<long>")
    keys = materialize(keys.select("*", F.col("s")[0].alias("node")), "sketches")
    of = F.struct("i", "t", "node")
    each = materialize(keys.groupBy("node").agg(F.min(of).alias("best"), F.min("s").alias("s")), "sketches-by-node")
    repeats = keys.count() > keys.select("i", "t").distinct().count()
    discard(keys)
    nodes = materialize(each.select("node", "best"), "nodes")
    met, near = buckets(each.select("node", F.slice("s", 3, BANDS).alias("keys"))), covered(each.select("node", F.col("s")[1].alias("fp")))
    discard(each)
    # texts travel only for nodes that meet another one; rows are known by (i, t) and never written again
    needed = met.select("node").union(near.select("a")).union(near.select("b")).distinct().join(nodes, "node").select("best.*")
    needed = materialize(needed, "needed")
    texts = docs.select(id_.alias("i"), F.xxhash64(text).alias("t"), text.alias("text")).join(needed, ["i", "t"]).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "bucket-texts")
    close = materialize(_linked(near, texts, least, words), "links")
    found = links(met, texts, None if close.isEmpty() else close, least, words)
    groups = stars(found)
    best = nodes.join(groups, nodes.node == groups.id, "left").groupBy(F.coalesce("component", "node").alias("g")).agg(F.min("best").alias("best")).select("best.i", "best.t")
    best = materialize(best, "kept")
    for done in (texts, needed, nodes, met, near):
        discard(done)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.where(id_.isNotNull()).select(row, id_.alias("i"), F.xxhash64(text).alias("t")).join(best, ["i", "t"], "left_semi")
    if repeats:
        kept = kept.dropDuplicates(["i", "t"])
    return kept.select("row.*").unionByName(docs.where(id_.isNull()))
