"""Exact removal of repeated byte strings with sampled, distributed suffix arrays.

A byte is removed when some ``length``-byte string that covers it also starts earlier. Every such
string holds an anchor: an ``anchor``-byte gram whose hash is least among ``length - anchor + 1``
neighbours, chosen by content alone, so all occurrences of the string hold it at the same place.

1. Each document's anchors are found by vectorised rolling hashes, a window of the text at a time. An anchor's hash and a 128-bit
   BLAKE2b digest of its context (all bytes of the strings that hold it) are shuffled, once per batch and context.
2. A context that occurs earlier, digest for digest, is removed whole. First occurrences of an anchor's differing
   contexts are cut from the documents and meet by anchor: there the suffixes that can repeat are put
   into an enhanced suffix array, and a stack scan over the common-prefix lengths meets every node of the common-prefix interval
   tree. Nodes whose occurrences have differing left extensions are the maximal repeat groups, all occurrences of each
   being a range of the suffix array; every occurrence but the earliest is removed. Bytes are compared here, hashes only group.
3. The removed ranges meet their document by id.

An occurrence that is not the earliest of a node is not the earliest of any node above it either, where less is removed. So each
suffix is reported once, at the deepest such node, and nested groups need no lists of their own.

Common anchors are known from a sample of the documents and dealt out by context; those with more than ``hot`` contexts send
their strings by content instead of by anchor, so no group grows with the input. The sample decides where rows go, never what is
removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

LENGTH = 100
ANCHOR = 40
HOT = 20_000
#: One in so many documents shows which anchors are common, and so many of these are broadcast, at most.
SAMPLED, LISTED = 32, 100_000
#: Parts that a common anchor's contexts are dealt to.
SALTS = 1024
#: Bytes of a text whose anchors are looked for at a time.
WINDOW = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class Rolling:
    """Polynomial hashes modulo 2^64 of substrings, by prefix sums."""

    def __init__(self) -> None:
        self.size = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(self.size, x, _U)])) for x in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64))))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(_U) + _U(1)) * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each [start, end)."""
        with np.errstate(over="ignore"):
            x = (prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
            x ^= x >> _U(31)
            x *= _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(29)
            x *= _U(0x94D049BB133111EB)
            return x ^ (x >> _U(32))


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` of each run of ``width`` values, by doubling."""
    now, size = values, 1
    while 2 * size <= width:
        now, size = least(now[:-size], now[size:]), 2 * size
    n = len(values) - width + 1
    return least(now[:n], now[width - size : width - size + n]) if size < width else now[:n]


def anchors(rolling: Rolling, text: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Hashes of the anchors, starts and ends of their contexts.

    A window's anchors depend on ``length - anchor`` grams to either side of it, which are read with it; memory follows the window,
    not the text.
    """
    n, width = len(text), length - anchor + 1
    grams_, place = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    last = n - anchor + 1 if n >= length else 0
    for lo in range(0, last, WINDOW):
        hi = min(lo + WINDOW, last)
        a, b = max(0, lo - width + 1), min(last, hi + width - 1)
        at = np.arange(b - a)
        grams = rolling.of(rolling.prefix(text[a : b + anchor - 1]), at, at + anchor)
        pad = np.zeros(width - 1, _U)
        held = _slide(np.concatenate([pad, _slide(grams, width, np.minimum), pad]), width, np.maximum)
        chosen = np.flatnonzero((held == grams)[lo - a : hi - a]) + lo
        grams_.append(grams[chosen - a])
        place.append(chosen)
    at = np.concatenate(place)
    return np.concatenate(grams_), np.maximum(at - (length - anchor), 0), np.minimum(at + length, n)


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(ranges, 2): a 128-bit digest of each range's bytes."""
    whole = memoryview(data)
    return np.frombuffer(b"".join(blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64).reshape(-1, 2)


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as maximal runs in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _common(ordered: list[bytes]) -> list[int]:
    """Common-prefix lengths of neighbours in a sorted list: one more than its length, zero at both ends."""
    out = [0] * (len(ordered) + 1)
    number = int.from_bytes
    for x in range(1, len(ordered)):
        a, b = ordered[x - 1], ordered[x]
        n = min(len(a), len(b))
        differ = number(a[:n], "big") ^ number(b[:n], "big")
        out[x] = n - (differ.bit_length() + 7) // 8
    return out


def interval_groups(suffixes: list[tuple[bytes, tuple]], left: list[int], length: int) -> tuple[list[int], list[tuple]]:
    """The maximal repeats of at least ``length`` bytes among suffixes ``(bytes, place)``.

    Returns the suffix array (indices in order) and for each group ``(depth, lo, hi, first, rest)``: its occurrences are the
    array's places [lo, hi), ``first`` is the earliest one and ``rest`` those that are the earliest of a node below, but not here.
    ``left`` is the byte to the left of each suffix, or a negative number of its own where that is not known. The stack scan over
    common-prefix lengths meets each node of the interval tree once; a node whose occurrences all continue one byte to the
    left is part of a longer repeat, which is reported there, and is left out.
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][0])
    lcp = _common([suffixes[i][0] for i in order])
    groups: list[tuple] = []
    stack: list[list] = []  # nodes: depth, lo, left byte (None: differing), earliest, rest

    def add(node: list, left_byte: int | None, earliest: int) -> None:
        if node[2] != left_byte:
            node[2] = None
        if suffixes[earliest][1] < suffixes[node[3]][1]:
            node[3], earliest = earliest, node[3]
        node[4].append(earliest)

    for x, i in enumerate(order, 1):
        depth, lo, byte, earliest = lcp[x], x - 1, left[i], i
        while stack and stack[-1][0] > depth:
            node = stack.pop()
            add(node, byte, earliest)
            at, lo, byte, earliest, rest = node
            if byte is None:
                groups.append((at, lo, x, earliest, rest))
        if depth < length:
            continue  # no open node is shallower
        if stack and stack[-1][0] == depth:
            add(stack[-1], byte, earliest)
        else:
            stack.append([depth, lo, byte, earliest, []])
    return order, groups


def maximal_repeats(data: bytes, starts: list[int], ends: list[int], length: int) -> list[tuple[int, list[int]]]:
    """Maximal repeats among suffixes ``data[start:end]``: (length, all starts), at least ``length`` long."""
    suffixes = [(data[a:b], (a,)) for a, b in zip(starts, ends, strict=True)]
    order, groups = interval_groups(suffixes, [data[a - 1] if a else -1 for a in starts], length)
    return [(depth, [starts[i] for i in order[lo:hi]]) for depth, lo, hi, _, _ in groups]


def _trees(rolling: Rolling, group: np.ndarray, contexts: list[bytes], place: list[tuple[int, int]], length: int) -> Iterator[tuple]:
    """For each group of contexts (places, the context and start in it of each, suffix array, maximal repeat groups).

    ``place`` is each context's document and start in it; contexts may overlap. Strings are first classed by a 64-bit
    hash with the group; classes of one, and classes whose members all have the same byte to the
    left, hold no maximal repeat's start and never enter the suffix array. A hash shared by different strings only lets more in.
    """
    size = np.array([len(c) for c in contexts])
    base = np.concatenate([[0], np.cumsum(size)])
    data = b"".join(contexts)
    text = np.frombuffer(data, np.uint8)
    count = np.maximum(size - length + 1, 0)
    of = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + base[of]
    if not len(of):
        return
    with np.errstate(over="ignore"):
        key = rolling.of(rolling.prefix(text), start, start + length) + group[of] * _U(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    members = np.diff(np.r_[new, len(order)])
    left = np.where(start == base[of], -1 - start, text[np.maximum(start - 1, 0)].astype(np.int64))
    mine = left[order]
    diverse = (members > 1) & (np.minimum.reduceat(mine, new) != np.maximum.reduceat(mine, new))
    kept = order[np.repeat(diverse, members)]
    if not len(kept):
        return
    starts, ends = base[:-1].tolist(), base[1:].tolist()
    kept = kept[np.argsort(group[of[kept]], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, group[of[kept]][1:] != group[of[kept]][:-1]]).tolist() + [len(kept)]
    for lo, hi in zip(cuts, cuts[1:]):
        part = np.sort(kept[lo:hi])
        longest: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for a, c, before in zip(start[part].tolist(), of[part].tolist(), left[part].tolist(), strict=True):  # overlapping contexts hold a place more than once
            spot, seen = (place[c][0], place[c][1] + a - starts[c]), (ends[c] - a, a, c, before)
            if seen > longest.get(spot, (0, 0, 0, 0)):
                longest[spot] = seen
        suffixes = [(data[a : ends[c]], spot) for spot, (_, a, c, _) in longest.items()]
        held = [(c, a - starts[c]) for _, a, c, _ in longest.values()]
        yield [spot for _, spot in suffixes], held, *interval_groups(suffixes, [x[3] for x in longest.values()], length)


def _later(rolling: Rolling, group: np.ndarray, contexts: list[bytes], place: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(context, start, end) ranges that repeat an earlier place of their group, one row for each maximal run of a context."""
    out = []
    for _, held, _, groups in _trees(rolling, group, contexts, place, length):
        found: dict[int, list[tuple[int, int]]] = {}
        for depth, _, _, _, rest in groups:
            for i in rest:
                c, at = held[i]
                found.setdefault(c, []).append((at, at + depth))
        for c, ranges in found.items():
            ranges.sort()
            first, last = ranges[0]
            for a, b in ranges[1:]:
                if a > last:
                    out.append((c, first, last))
                    first = a
                last = max(last, b)
            out.append((c, first, last))
    return out


def _small(batches: Iterator[pa.RecordBatch], column: int, size: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of a binary column."""
    for batch in batches:
        ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


_SCAN = "key long, c1 long, c2 long, doc long, start int, end int, dup boolean"


def _scan(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row for each anchor whose context is new in its batch; the others are removed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in _small(batches, 1, 4 << 20):
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            parts = []
            for i in range(len(ids)):
                data = (texts[i].as_py() if texts[i].is_valid else None) or b""
                a, s, e = anchors(rolling, np.frombuffer(data, np.uint8), length, anchor)
                if len(a):
                    parts.append((a, digests(data, s, e), np.full(len(a), ids[i]), s, e))
            if not parts:
                continue
            a, c, d, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, d, c[:, 1], c[:, 0], a))  # of equal anchors and contexts the earliest comes first
            a, c, d, s, e = a[order], c[order], d[order], s[order], e[order]
            seen = np.r_[False, (a[1:] == a[:-1]) & (c[1:] == c[:-1]).all(axis=1)]
            yield _rows(a[~seen], c[~seen], d[~seen], s[~seen], e[~seen], False)
            if seen.any():  # whole runs, by document
                d, s, e = d[seen], s[seen], e[seen]
                order = np.lexsort((s, d))
                d, s, e = d[order], s[order], e[order]
                cut = np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)]
                runs = [(d[lo], *joined(s[lo:hi], e[lo:hi])) for lo, hi in zip(cut, cut[1:])]
                d = np.concatenate([np.full(len(x), i) for i, x, _ in runs])
                s, e = (np.concatenate([r[k] for r in runs]) for k in (1, 2))
                yield _rows(d * 7919 + s, np.stack([d, s], axis=1), d, s, e, True)

    return docs.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCAN)


def _rows(a, c, d, s, e, dup: bool) -> pa.RecordBatch:
    columns = [a.view(np.int64), c[:, 0].astype(np.int64), c[:, 1].astype(np.int64), d.astype(np.int64), s.astype(np.int32), e.astype(np.int32), np.full(len(a), dup)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "c1", "c2", "doc", "start", "end", "dup"])


def _common_anchors(docs: DataFrame, length: int, anchor: int, sampled: int) -> DataFrame:
    """``(key)`` of the anchors that come most often in a sample. An anchor left out holds at most 1/LISTED of its rows."""
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(sampled)) == 0)
    counted = _scan(some, length, anchor).where("not dup").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 64")
    return materialize(counted.orderBy(F.desc("n")).limit(LISTED).select("key"), "common-anchors")


def _contexts(rows: DataFrame, length: int, hot: int) -> DataFrame:
    """Cut the contexts from their documents; strings of hot anchors go by their own content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, unpack = Rolling(), zstandard.ZstdDecompressor()
        for batch in _small(batches, 1, 1 << 20):
            out, done = [], []
            hot_rows: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            docs = sorted(zip(*(batch.column(n).to_pylist() for n in ("doc", "packed", "reps")), strict=True), key=lambda r: r[0])
            for doc, packed, reps in docs:
                text = unpack.decompress(packed)
                for r in sorted(reps, key=lambda r: r["start"]):
                    s, e = r["start"], r["end"]
                    if r["n"] <= hot:
                        out.append((r["key"], doc, s, text[s:e]))
                        continue
                    prefix = rolling.prefix(np.frombuffer(text[s:e], np.uint8))
                    at = np.arange(e - s - length + 1)
                    for a, h in zip(at.tolist(), rolling.of(prefix, at, at + length).view(np.int64).tolist(), strict=True):
                        here = (doc, s + a, h)
                        if (first := hot_rows.setdefault((r["key"], text[s + a : s + a + length]), here)) is not here and first[:2] != here[:2]:
                            done.append((doc, s + a, s + a + length))
                out.extend((key ^ here[2], *here[:2], string) for (key, string), here in hot_rows.items() if here[0] == doc)
            out_cols = list(zip(*out, strict=True)) or [[]] * 4
            done_cols = list(zip(*done, strict=True)) or [[]] * 3
            k, m = len(out), len(done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*out_cols[0], *(x * 31 + y for x, y in zip(done_cols[0], done_cols[1], strict=True))], pa.int64()),
                    pa.array([*out_cols[1], *done_cols[0]], pa.int64()),
                    pa.array([*out_cols[2], *done_cols[1]], pa.int32()),
                    pa.array([*([None] * k), *done_cols[2]], pa.int32()),
                    pa.array([*out_cols[3], *([None] * m)], pa.binary()),
                ],
                names=["key", "doc", "start", "end", "bytes"],
            )

    return rows.mapInArrow(run, "key long, doc long, start int, end int, bytes binary")


def _compare(contexts: DataFrame, length: int, groups_only: bool = False) -> DataFrame:
    """Ranges to remove, from the contexts that share an anchor; or their maximal repeat groups."""
    groups = contexts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc", "start", "end", "bytes"))).alias("rows"))
    groups = groups.where("size(rows) > 1 or rows[0].end is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            rows, offsets = batch.column(0).values, batch.column(0).offsets.to_numpy()
            for lo, hi in _bounded(offsets):
                part = rows.slice(offsets[lo] , offsets[hi] - offsets[lo])
                doc, start, end = (part.field(n) for n in ("doc", "start", "end"))
                keep = np.flatnonzero(end.is_null().to_numpy(zero_copy_only=False))
                group = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
                doc_, start_ = doc.to_numpy(), start.to_numpy()
                d, s, e = [], [], []
                done = np.flatnonzero(~end.is_null().to_numpy(zero_copy_only=False))
                d.append(doc_[done])
                s.append(start_[done].astype(np.int64))
                e.append(end.take(pa.array(done)).to_numpy(zero_copy_only=False).astype(np.int64))
                place = list(zip(doc_[keep].tolist(), start_[keep].tolist(), strict=True))
                given = (rolling, group[keep].astype(_U), part.field("bytes").take(pa.array(keep)).to_pylist(), place, length)
                if groups_only:
                    for spots, _, order, nodes in _trees(*given) if len(keep) else ():
                        for depth, a, b, _, _ in nodes:
                            yield pa.RecordBatch.from_pylist([{"length": depth, "occurrences": [{"doc": spots[i][0], "start": spots[i][1]} for i in order[a:b]]}], groups_type)
                    continue
                found = _later(*given) if len(keep) else []
                if found:
                    i, a, b = (np.array(x) for x in zip(*found, strict=True))
                    i = keep[i]
                    d.append(doc_[i])
                    s.append(start_[i] + a)
                    e.append(start_[i] + b)
                d, s, e = (np.concatenate(x) for x in (d, s, e))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "start", "end"])

    groups_type = pa.schema([("length", pa.int32()), ("occurrences", pa.list_(pa.struct([("doc", pa.int64()), ("start", pa.int32())])))])
    return groups.select("rows").mapInArrow(run, "length int, occurrences array<struct<doc:bigint,start:int>>" if groups_only else "doc long, start int, end int")


def _bounded(offsets: np.ndarray, rows: int = 6_000) -> Iterator[tuple[int, int]]:
    """Slices of whole groups with about ``rows`` rows each."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + rows, "right")) - 1)
        yield lo, hi
        lo = hi


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _small(batches, 0, 1 << 20):
            out = []
            for packed, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack.decompress(packed)
                s, e = joined(*(np.array([r[k] for r in ranges or ()], np.int64) for k in ("start", "end")))
                left, at = [], 0
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                out.append((len(text), int((e - s).sum()), len(s), b"".join(left)))
            n, removed, spans, left = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("packed", "ranges", "doc_id").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes, so that the shuffles by document move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part in _small(batches, 2, 4 << 20):
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack.compress(t or b"") for t in part.column(2).to_pylist()], pa.binary())], names=["doc", "doc_id", "packed"])

    return docs.select("doc", "doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc long, doc_id long, packed binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc, doc_id, text)`` with ``doc`` a key in document order, and the same with each key once.

    That is the id itself where it is unique and never null. Otherwise the distinct pairs of id and
    text are sorted and numbered (null ids first).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        docs = docs.withColumn("doc", F.col("doc_id"))
        return docs, docs
    docs = docs.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = docs.select("doc_id", "hash").distinct().orderBy("doc_id", "hash").withColumn("doc", F.monotonically_increasing_id())
    keys = materialize(keys, "keys").withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    docs = docs.join(keys, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.hash == keys._hash)).select("doc", "doc_id", "text")
    return docs, docs.dropDuplicates(["doc"])


def _marked(once: DataFrame, length: int, anchor: int, hot: int, sampled: int) -> DataFrame:
    """``(key, doc, start, end, done, n)``: contexts that occur earlier (done), and the first ones of anchors that have ``n``
    differing contexts.

    Rows meet by anchor; those of common anchors by anchor and context, and count as ``hot``.
    """
    common = _common_anchors(once, length, anchor, sampled)
    rows = _scan(once, length, anchor).join(F.broadcast(common.withColumn("common", F.lit(True))), "key", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    by = ["key", F.when(F.col("common"), F.pmod("c1", F.lit(SALTS))).otherwise(F.lit(0))]
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).where("n > 1 or dup or common")
    order = whole.orderBy("c1", "c2", "doc", "start")
    again = F.coalesce((F.lag("c1").over(order) == F.col("c1")) & (F.lag("c2").over(order) == F.col("c2")), F.lit(False))
    rows = rows.withColumn("again", again)
    differing = F.when(F.col("common"), F.lit(hot + 1)).otherwise(F.sum((~F.col("again")).cast("long")).over(whole))
    rows = rows.withColumn("n", differing).where("dup or again or n > 1")
    return materialize(rows.select("key", "doc", "start", "end", F.expr("dup or again").alias("done"), "n"), "anchors")


def _split(docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int, hot: int, sampled: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their texts packed, the marked anchors, and the contexts that meet by anchor."""
    keyed, once = _keyed(docs, id_col, text_col)
    marked = _marked(once, length, anchor, hot, sampled)
    packed = _packed(keyed)
    reps = marked.where("not done").groupBy("doc").agg(F.collect_list(F.struct("key", "start", "end", "n")).alias("reps"))
    texts = packed if once is keyed else _packed(once)
    return packed, marked, _contexts(texts.join(reps, "doc").select("doc", "packed", "reps"), length, hot)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row per document; ``kept`` are the bytes left.

    A null text is empty; texts under ``length`` bytes are kept whole. "Earlier" means a smaller doc_id
    or an earlier start; null ids come first. Rows that repeat an id are ordered by a hash of
    their text, and rows that repeat both id and text are one document, returned as often as it
    came. Strings never cross documents and are judged on the input. A very long text needs some 40 bytes of memory for each 30
    of its own (its anchors and their digests). An empty table gives an empty result.
    """
    packed, marked, contexts = _split(docs, id_col, text_col, length, anchor, hot, sampled)
    found = materialize(_compare(contexts, length), "ranges")
    ranges = marked.where("done").select("doc", "start", "end").union(found)
    ranges = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return _cut(packed.join(ranges, "doc", "left"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """``(length, occurrences)``: the maximal repeat groups that :func:`remove_repeats` works on, each with all its places.

    Places are (document number, start); documents are numbered by id where ids are unique. Copies whose whole context is equal
    stand for each other: the earliest is listed. Nested groups repeat their places, so the list can be far larger than the input.
    """
    _, _, contexts = _split(docs, id_col, text_col, length, anchor, hot, sampled)
    return _compare(contexts, length, groups_only=True)


def digest(kept: DataFrame) -> DataFrame:
    """The bytes left as a SHA-256."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
