"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded (lower case, every run of ASCII other than letters and digits one space) and compared as UTF-8 bytes.
A document region within ``e`` edits of an item of ``m`` bytes shares at least ``m - q + 1 - q * e`` of the item's
q-grams with it, on diagonals (place in document minus place in item) at most ``e`` apart. So shared q-grams are
counted in diagonal bands of width 2w that overlap by w > e: the alignment's diagonals lie within one band whole.
Bands that reach the bound are aligned; all regions within the budget are leaks. ``w`` is each item's own budget and one, so
what is found for an item does not depend on the items beside it.

The items pass through the driver and go to the executors in blocks of ``BLOCK_BYTES``, one scan of the documents for each
block. That bounds memory whatever their number; it suits lists up to some GB, not a second corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: Edits allowed for each byte of an item.
RATE = 0.1
#: Folded bytes of the items that one scan carries.
BLOCK_BYTES = 16 << 20
#: Folded bytes of documents that are looked up together.
CHUNK = 1 << 18

_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """All q-grams (q at most 8) as integers."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.ndarray((n,), "<u8", data + b"\0" * (8 - q), strides=(1,))
    return out & np.uint64((1 << (8 * q)) - 1) if q < 8 else out.astype(np.uint64)


class Items:
    """One block of items with its q-gram index."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE, q: int = Q) -> None:
        self.q, self.ids, self.text = q, [i for i, _ in items], [t for _, t in items]
        size = np.array([len(t) for t in self.text], np.int64)
        # as many edits as leave at least q shared q-grams to count, and none in a very short item
        self.budget = np.maximum(np.minimum((rate * size).astype(np.int64), (size - 2 * q + 1) // q), 0)
        self.least = np.maximum(size - q + 1 - q * self.budget, 1)
        self.width = self.budget + 1
        self.low = -(size // self.width) - 1
        self.longest = int(size.max(initial=0))
        all_ = [grams(t, q) for t in self.text]
        key = np.concatenate([*all_, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(all_)), [len(g) for g in all_])
        at = np.concatenate([*[np.arange(len(g)) for g in all_], np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.of, self.at = of[order].astype(np.int64), at[order].astype(np.int64)
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = 22
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.key)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (g * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item, low diagonal, high diagonal) of the bands that reach their item's bound."""
        g = grams(data, self.q)
        if not len(self.key) or not len(g):
            return []
        place = np.flatnonzero(self.filter[self._slot(g)])
        slot = np.minimum(np.searchsorted(self.key, g[place]), len(self.key) - 1)
        hit = self.key[slot] == g[place]
        place, slot = place[hit], slot[hit]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.of[entry], np.repeat(place, n) - self.at[entry]
        # counts in steps of a band's half; a band is two neighbouring steps, the last step of an item is never reached
        steps = len(data) // self.width - self.low + 2
        first = np.cumsum(steps) - steps
        key = first[item] + diagonal // self.width[item] - self.low[item]
        if first[-1] + steps[-1] <= 4 * len(key) + (1 << 20):
            count = np.bincount(key, minlength=int(first[-1] + steps[-1]) + 1)
            kinds = np.flatnonzero(count)
            count, after = count[kinds], count[kinds + 1]
        else:
            kinds, count = np.unique(key, return_counts=True)
            after = np.append(np.where(kinds[1:] == kinds[:-1] + 1, count[1:], 0), 0) if len(kinds) else count
        of = np.searchsorted(first, kinds, "right") - 1
        ok = count + after >= self.least[of]
        if not ok.any():
            return []
        # an item's q-gram counts once in a band, however often the document repeats it
        bands, of = kinds[ok], of[ok]
        spots, at = np.int64(self.longest + 1), self.at[entry]
        pairs = np.unique(np.concatenate([np.searchsorted(bands, b[on]) * spots + at[on] for b in (key, key - 1) for on in [np.isin(b, bands)]]))
        ok = np.bincount(pairs // spots, minlength=len(bands)) >= self.least[of]
        out: list[tuple[int, int, int]] = []
        for i, s in zip(of[ok].tolist(), (bands[ok] - first[of[ok]]).tolist(), strict=True):
            width = int(self.width[i])
            lowest = (s + int(self.low[i])) * width
            last = lowest + 2 * width - 1
            if out and out[-1][0] == i and lowest <= out[-1][2] and last - out[-1][1] < 4 * width:
                out[-1] = (i, out[-1][1], last)  # bands that overlap are aligned as one
            else:
                out.append((i, lowest, last))
        return out


def align(item: bytes, data: bytes, low: int, high: int, budget: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of every match of the whole item in ``data`` that ends on a diagonal in [low, high].

    Banded dynamic programming: cell (i, d) is item prefix i against data up to i + d; any start is free. Alignments
    within the budget stay within ``budget`` diagonals of their end, so what is found does not depend on the band. Where the
    item stands unchanged, only unchanged places are listed: every other match there overlaps one.
    """
    exact, at = [], data.find(item, max(0, low))
    while 0 <= at <= high:
        exact.append((0, at, at + len(item)))
        at = data.find(item, at + 1)
    if exact:
        return exact
    d = np.arange(low - budget, high + budget + 1)
    far = len(item) + len(data) + 1
    text = np.frombuffer(data, np.uint8)
    inside = (d >= 0) & (d <= len(data))
    cost, start = np.where(inside, 0, far), d.copy()
    steps = np.arange(len(d))
    for i, c in enumerate(item, 1):
        col = i + d  # data[col - 1] is compared with c
        valid = (col >= 1) & (col <= len(data))
        same = np.zeros(len(d), bool)
        same[valid] = text[col[valid] - 1] == c
        diag = np.where(valid, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # the item's byte has no partner
        skip[(col < 0) | (col > len(data))] = far
        best, origin = diag, start
        from_skip = skip < best
        best = np.where(from_skip, skip, best)
        origin = np.where(from_skip, np.append(start[1:], 0), origin)
        # data bytes without a partner: a running minimum along the row
        slope = best - steps
        least = np.minimum.accumulate(slope)
        at = np.maximum.accumulate(np.where(slope == least, steps, 0))
        cost, start = np.minimum(least + steps, far), origin[at]
        if cost.min() > budget:
            return []
    good = np.flatnonzero((cost <= budget) & (d >= low) & (d <= high))
    return [(int(cost[k]), max(0, int(start[k])), int(len(item) + d[k])) for k in good]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = fold(row.t)
        if len(text) < Q or row.i is None:
            continue
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Every document region within the edit budget of a benchmark item, one row per region.

    Returns ``(doc_id, item_id, edits, similarity, region_start, region_end)``; places are bytes of the folded
    document, ``similarity`` is 1 - edits / item bytes. Of regions of one item that overlap the one with the fewest edits
    stays (ties: the first). Null and empty texts have no region; items with a null id or of under ``Q`` folded bytes
    match nothing. Rows that repeat an id are looked at each for itself. No item, or no document: an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits int, similarity double, region_start long, region_end long"
    out = None
    for block in _blocks(items, id_col=item_id, text_col=item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                found, at = [], 0
                while at < len(ids):
                    part, size = [], 0
                    while at < len(ids) and (not part or size < CHUNK):
                        part.append((ids[at], fold(texts[at].as_py())))
                        size += len(part[-1][1])
                        at += 1
                    found.extend(_matches(index, part))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "similarity", "region_start", "region_end"])

        here = rows.mapInArrow(run, schema)
        out = here if out is None else out.union(here)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _matches(index: Items, docs: list[tuple[int, bytes]]) -> list[tuple]:
    """Leaks of a few documents, looked up as one string with zero bytes between them."""
    gap = b"\0" * (index.q + 2)
    ends = np.cumsum([len(t) + len(gap) for _, t in docs])
    starts = ends - [len(t) + len(gap) for _, t in docs]
    data = b"".join(t + gap for _, t in docs)
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item, low, high in index.candidates(data):
        text, budget = index.text[item], int(index.budget[item])
        # a band may reach over two documents' border: it is looked at in each that it touches
        lo = int(np.searchsorted(ends, max(0, low - budget), "right"))
        hi = int(np.searchsorted(ends, max(0, high + len(text) + budget), "right"))
        for k in range(lo, min(hi + 1, len(docs))):
            base = int(starts[k])
            if hits := align(text, docs[k][1], low - base, high - base, budget):
                best.setdefault((k, item), []).extend(hits)
    out = []
    for (k, item), hits in sorted(best.items()):
        kept: list[tuple[int, int, int]] = []
        for edits, a, b in sorted(set(hits)):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((edits, a, b))
        n = len(index.text[item])
        out.extend((docs[k][0], index.ids[item], e, 1 - e / n, a, b) for e, a, b in sorted(kept, key=lambda h: h[1]))
    return out
