"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two texts are linked when at most ``radius`` bits differ. Every bit
position gets a non-zero vector of ``radius + 1`` bits. For every non-zero vector v, mask v keeps
the positions whose vector has an odd inner product with v. Any ``radius`` positions span at most
``radius`` dimensions, so some v is orthogonal to all of them: its mask keeps none of the differing
positions, and the pair collides in that table. 2^(radius+1) - 1 tables (15 for radius 3) thus
find every pair within the radius, with about 34 of 64 bits to tell strangers apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import materialize, paired_blocks
from memlayer.llm.components import components

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints of one bucket that meet in one task.
BLOCK = 4096


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; zero for a null text or one without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not parts:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    count = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        to = min(count, at + (1 << 16))
        h = np.fromiter((digest(join(parts[i : i + words]), seed) for i in range(at, to)), np.uint64, to - at)
        ones += _ones(h)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes."""
    ones = sum((_ones(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The structured masks, as signed longs; bit i has the vector 1 + i mod (2^(radius+1) - 1)."""
    n = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph that links values within ``radius`` bits: index pairs.

    Each value is compared once with those not reached yet; no list of all pairs is made.
    """
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            hits = rest[near]
            if len(hits):
                rest = rest[~near]
                queue.extend(hits)
                left.extend([at] * len(hits))
                right.extend(hits)
    return left, right


def near_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``nodes(node, fp)`` with distinct fp -> ``(a, b)``, links that connect what the full graph connects."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))]))
    dealt = paired_blocks(nodes.select("node", "fp", keys.alias("k")).select("node", "fp", "k.t", "k.key"), ["t", "key"], "fp", block)
    groups = dealt.groupBy("t", "key", "_i", "_j").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps")).where(F.size("nodes") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ids, fps in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids.values.to_numpy()
                left, right = spanning_links(fps.values.to_numpy().view(np.uint64), radius)
                a.append(ids[left])
                b.append(ids[right])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    return groups.select("nodes", "fps").mapInArrow(run, "a long, b long")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Returns ``(doc_id, fingerprint, component_id, kept)``, one row per input row: 16 lowercase hex
    digits, the smallest doc_id reachable, and whether this row is that document. Null and empty
    texts, and texts of white space, have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so a group of copies costs one row after pre-aggregation; hot
    buckets are split into pairs of blocks. A null doc_id never names a component: such a row
    takes its group's smallest id (null if there is none) and is not kept. Rows that repeat a
    doc_id are returned as often as they came. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    # one id may stand for two fingerprints only if ids repeat; the links are then still right
    named = components(near_links(nodes, radius).distinct())
    repeated = nodes.join(named, nodes.node == named.id, "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(repeated, "fp", "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
