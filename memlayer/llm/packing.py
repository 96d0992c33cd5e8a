"""Packing tokenised documents into fixed-length sequences by swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into parts of bounded size
by a hash, each part is packed on its own, and bins that are not full meet again in ever fewer parts until one is left. Only
lengths and ids travel. A part starts from best fit in arrival order, which leaves one or two of a hundred bins too many;
the search then moves and exchanges documents until bins empty.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces of one part; a task holds one part's lengths and ids.
PART_PIECES = 60_000
#: Times that bins which are not full may meet again.
ROUNDS = 4
#: Texts that are encoded before their pieces are passed on.
STEP = 1024
#: Characters from which on a text is encoded by the slower library, which has no limit on a run.
LONG = 1_000_000


class TextIds:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

    Where the file is plain byte-level BPE, its vocabulary in id order is the merge order, and tiktoken
    gives the same ids several times faster. Other files, and texts of over ``LONG`` characters, go through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _fast(model: dict):
        import public_tokenizers
        import tiktoken

        split, bpe = model.get("pre_tokenizer") or {}, model["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not model.get("normalizer")
        if not plain or bpe.get("type") != "BPE" or bpe.get("dropout") or bpe.get("ignore_merges"):
            return None
        # printable bytes stand for themselves in such a vocabulary, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): i for word, i in bpe["vocab"].items() if word not in special}
        if [ranks.get(bytes(byte[c] for c in "".join(m))) for m in bpe["merges"]] != sorted(ranks.values())[256:]:
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or len(text) > LONG:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One encoder a Python worker, kept over its tasks."""
    return TextIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, its end id included."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, length = start + length, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Each piece in order into the fullest bin that takes it; a bit set of the free rooms finds it."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i, n in enumerate(lengths.tolist()):
        if fits := free >> n:
            room = n + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        room -= n
        if room:
            rooms[room].append(k)
            free |= 1 << room
    return bins


class Search:
    """Bins under exchange. ``rooms[r]`` lists bins with r free tokens; ``offers[v]`` what bins could give back so that a unit of
    up to ``v`` tokens fits.

    A bin with room r that gives back u tokens (one document, or two) is offered at r + u, so the tightest exchange for a unit
    of w tokens is the first offer from w on that gives back fewer. Entries of bins that changed since are passed over.
    """

    #: Offers looked at for one unit, and documents of a bin beyond which it offers no pairs.
    LOOKS, FEW = 48, 12

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int) -> None:
        self.size, self.capacity = size, capacity
        self.bins = bins
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.rooms: list[list] = [[] for _ in range(capacity + 1)]
        self.offers: list[list] = [[] for _ in range(capacity + 1)]
        self.free = self.some = 0
        for k in range(len(bins)):
            self.offer(k)

    def units(self, k: int) -> dict[int, tuple[int, ...]]:
        """Tokens -> one or two documents of a bin that hold so many, single documents first."""
        b, size = self.bins[k], self.size
        one = {size[i]: (i,) for i in b}
        if len(b) > self.FEW:
            return one
        two = {size[i] + size[j]: (i, j) for x, i in enumerate(b) for j in b[:x]}
        return two | one

    def offer(self, k: int) -> None:
        room, now = self.capacity - self.fill[k], self.version[k]
        if not room or not self.bins[k]:
            return
        self.rooms[room].append((k, now, 0, ()))
        self.free |= 1 << room
        for u, docs in self.units(k).items():
            self.offers[room + u].append((k, now, u, docs))
            self.some |= 1 << (room + u)

    def _first(self, table: str, lists: list[list], giver: int, w: int, pair: bool, end: int, looks: int):
        """The first live entry from ``w`` to before ``end``: (place, entry)."""
        least, v, mask = self.fill[giver], w, getattr(self, table) >> w
        while mask and looks > 0:
            step = (mask & -mask).bit_length() - 1
            v += step
            if v >= end:
                return None
            stack = lists[v]
            while stack and stack[-1][1] != self.version[stack[-1][0]]:
                stack.pop()
            if not stack:
                setattr(self, table, getattr(self, table) ^ 1 << v)
            for entry in stack[: -looks - 1 : -1]:
                looks -= 1
                k, now, u, docs = entry
                if now == self.version[k] and u < w and k != giver and self.fill[k] >= least and not (pair and len(docs) == 2):
                    return v, entry
            mask >>= step + 1
            v += 1
        return None

    def tightest(self, giver: int, w: int, pair: bool) -> tuple[int, int, tuple[int, ...]] | None:
        """(bin, tokens back, documents back) of the tightest move or exchange for ``w`` tokens of a bin at most as full."""
        move = self._first("free", self.rooms, giver, w, False, self.capacity + 1, 1 << 30)
        swap = None if move and move[0] == w else self._first("some", self.offers, giver, w, pair, move[0] if move else self.capacity + 1, self.LOOKS)
        found = swap or move
        return (found[1][0], *found[1][2:]) if found else None

    def exchange(self, giver: int) -> bool:
        """One move or exchange that brings the giver nearer to empty."""
        for w, docs in sorted(self.units(giver).items(), reverse=True):
            if not (found := self.tightest(giver, w, len(docs) == 2)):
                continue
            to, u, back = found
            self.bins[giver] = [i for i in self.bins[giver] if i not in docs] + list(back)
            self.bins[to] = [i for i in self.bins[to] if i not in back] + list(docs)
            self.fill[giver] += u - w
            self.fill[to] += w - u
            self.version[giver] += 1
            self.version[to] += 1
            self.offer(to)
            return True
        return False


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, passes: int = 8) -> list[list[int]]:
    """Move or exchange documents between underfull bins while the sum of squared fills grows.

    From the emptiest bin on, each bin gives one or two documents to a bin at least as full and takes
    back none, one or two that are shorter in sum (not two for two), where the fuller bin stays within
    capacity. The tightest exchange is taken. Every step raises the sum of squares, so the search
    ends; bins that lose all documents are dropped. Full bins are left alone; the search stops at the fewest bins that the tokens
    allow.
    """
    size = lengths.tolist()
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    search = Search([list(b) for b in bins if sum(size[i] for i in b) < capacity], size, capacity)
    fewest = -(-sum(search.fill) // capacity)
    for _ in range(passes):
        alive = [k for k, b in enumerate(search.bins) if b]
        left, changed = len(alive), False
        for k in sorted(alive, key=lambda k: search.fill[k]):
            if left <= fewest:
                break
            while search.bins[k] and search.exchange(k):
                changed = True
            left -= not search.bins[k]
            search.offer(k)
        if not changed or left <= fewest:
            break
    return full + [b for b in search.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of ``lengths`` by bin: the search from best fit in arrival order; where it misses the fewest bins that the
    tokens allow, also from its own underfull bins emptied and filled anew, and from best fit in decreasing order. The fewest bins
    stay."""
    fewest = -(-int(lengths.sum()) // capacity)

    def searched(some: np.ndarray) -> list[list[int]]:
        return [some[b].tolist() for b in local_search(best_fit(lengths[some], capacity), lengths[some], capacity)]

    every = np.arange(len(lengths))
    bins = searched(every)
    if len(bins) > fewest:
        room = [capacity - int(lengths[b].sum()) for b in bins]
        loose = np.array([i for b, r in zip(bins, room, strict=True) if r for i in b])
        anew = [b for b, r in zip(bins, room, strict=True) if not r] + searched(loose[np.argsort(-lengths[loose], kind="stable")])
        bins = min(bins, anew, key=len)
    if len(bins) > fewest:
        bins = min(bins, searched(np.argsort(-lengths, kind="stable")), key=len)
    return bins


def _packed(pieces_: DataFrame, part: str, capacity: int) -> DataFrame:
    """One round: pack each part; ``bin`` counts within the part, ``fill`` is the bin's tokens."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid", kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bin_, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
        for k, b in enumerate(pack(lengths, capacity)):
            ends = np.cumsum(lengths[b])
            bin_[b], offset[b], fill[b] = k, ends - lengths[b], ends[-1]
        return frame.assign(bin=bin_, offset=offset, fill=fill)

    # ids stay out of pandas, where a null would turn the others into floating-point numbers
    rows = pieces_.select("pid", "length", F.expr(part).cast("long").alias("part"))
    return rows.groupBy("part").applyInPandas(run, "pid long, length long, part long, bin long, offset long, fill long")


def pack_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    Returns one row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.
    A null or empty text is its end id alone, one token. Only documents of more than ``capacity``
    tokens are cut; all their pieces but the first are whole sequences. Rows that repeat a doc_id are
    packed each for itself; a null doc_id stays null. Sequence ids are numbers made of round, part and bin, so no two sequences
    share one. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, capacity, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // part_pieces))
    now = materialize(_packed(rest, f"pmod(xxhash64(pid), {parts})", capacity), "packed")
    done = None
    for level in range(ROUNDS):
        last = parts == 1 or level == ROUNDS - 1
        # bins of a part are fewer than 2^20, rounds than 7
        number = (F.shiftleft("part", 20) + F.col("bin")) * 8 + level
        ready = (now if last else now.where(F.col("fill") == capacity)).select("pid", number.alias("sequence_id"), "offset")
        done = ready if done is None else done.union(ready)
        if last:
            break
        # the bins that are not full, in as many parts as keep each within a task
        left = now.where(F.col("fill") < capacity)
        parts = max(1, -(-left.count() // part_pieces))
        now = materialize(_packed(left, f"pmod(xxhash64(part, bin), {parts})", capacity), "packed")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.where(F.col("length") == capacity).select(*columns, (F.col("pid") * 8 + 7).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(done, "pid").select(*columns, "sequence_id", "offset").union(whole)
