"""Exact cosine search in blocks: the nearest vectors of many queries, and a threshold join, by matrix products within tasks.

Query vectors travel in broadcast blocks of bounded size; each Arrow batch of stored vectors meets a block as one matrix. Within
a block queries are grouped by their nearest pivot. Angles obey the triangle inequality, so a stored vector is compared with
a group only if its angle to the pivot, less the group's radius, can still reach what is asked: the threshold, or the k-th score
that the task has seen so far. Tasks write their k best rows of each query or the pairs above the threshold, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from memlayer.functions.arrow import record_batch
from memlayer.operators.retrieval import top_k
from memlayer.sources.steps import materialize

#: Bytes of query vectors that one scan of the stored vectors carries; more queries take more scans.
BLOCK_BYTES = 64 << 20
#: Query groups of a block, at most.
PIVOTS = 64
#: What rounding may add to a bound.
SLACK = 1e-9


@dataclass
class Block:
    """Unit query vectors of one length, sorted by group: ids, rows, and for each group its pivot, radius and rows."""

    ids: list
    unit: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    bounds: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def of(ids: list, unit: np.ndarray) -> Block:
        """Groups around pivots that lie far from each other, each found as the vector farthest from those before."""
        count = max(1, min(PIVOTS, len(ids) // 4))
        chosen, near = [0], np.full(len(ids), -np.inf)
        for _ in range(count - 1):
            near = np.maximum(near, unit @ unit[chosen[-1]])
            chosen.append(int(near.argmin()))
        angle = np.arccos(np.clip(unit @ unit[chosen].T, -1, 1))
        group = angle.argmin(axis=1)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(count + 1))
        radius = np.array([angle[order[a:b], g].max(initial=0) for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
        return Block([ids[i] for i in order], unit[order], unit[chosen], radius, list(zip(edges.tolist(), edges[1:].tolist(), strict=False)))

    def parts(self, unit: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first, last, rows, scores)`` of each group with the rows that may reach ``need`` of one of its queries."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1)) - self.radius
        best = np.cos(np.maximum(angle, 0)) + SLACK
        for g, (a, b) in enumerate(self.bounds):
            if a < b and len(rows := np.flatnonzero(best[:, g] >= need[a:b].min())):
                yield a, b, rows, unit[rows] @ self.unit[a:b].T


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, unit vectors)`` of a list column, for each length of vectors; null, zero and non-finite ones are left out."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == n)
        rows = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
        with np.errstate(all="ignore"):
            length = np.sqrt(np.square(rows).sum(axis=1))
            fine = (length > 0) & np.isfinite(length)
            yield places[fine], rows[fine] / length[fine, None]


def blocks(queries: DataFrame, id_col: str, vector_col: str, size: int = BLOCK_BYTES) -> Iterator[list[Block]]:
    """The queries as blocks of ``size`` bytes; one block is on the driver at a time."""
    kind = pa.list_(pa.float64())
    held, rows = 0, []

    def built() -> list[Block]:
        found: dict[int, tuple[list, list]] = {}
        for places, unit in unit_rows(pa.array([r[1] for r in rows], kind)):
            ids, units = found.setdefault(unit.shape[1], ([], []))
            ids += [rows[i][0] for i in places]
            units.append(unit)
        return [Block.of(ids, np.vstack(units)) for ids, units in found.values() if ids]

    chosen = queries.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    for row in chosen.toLocalIterator(prefetchPartitions=True):
        rows.append(row)
        held += 8 * len(row.v)
        if held >= size:
            yield built()
            held, rows = 0, []
    if rows:
        yield built()


def _result(vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str, names: tuple[str, str]) -> StructType:
    kinds = {names[0]: queries.schema[query_id].dataType, names[1]: vectors.schema[id_col].dataType}
    return StructType([StructField(n, t) for n, t in kinds.items()]).add("score", "double")


def nearest(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: int, digits: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, id, score, rank)``: each query's ``k`` nearest vectors of positive cosine (RET4, RET5, JN4); ties by id.

    Scores are rounded to ``digits`` before they are ranked. Vectors of another length, null, zero or non-finite ones match
    nothing. The queries are read when this is called. No query: an empty result.
    """
    schema = _result(vectors, queries, id_col, query_id, ("query_id", "id"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = None
    for block in blocks(queries, query_id, query_vector, block_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [_Best(b, k, digits) for b in shared.value]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for places, unit in unit_rows(batch.column(1)):
                    for best in held:
                        if best.block.unit.shape[1] == unit.shape[1]:
                            best.add([ids[i] for i in places], unit)
            for best in held:
                if found := best.rows():
                    yield record_batch(found, schema)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return top_k(out, k)


class _Best:
    """The ``k`` best rows of each query of a block so far."""

    def __init__(self, block: Block, k: int, digits: int | None) -> None:
        self.block, self.k, self.digits = block, k, digits
        self.kept: list[list[tuple[float, object]]] = [[] for _ in block.ids]
        self.need = np.full(len(block.ids), 0.0)

    def add(self, ids: list, unit: np.ndarray) -> None:
        margin = SLACK if self.digits is None else 0.51 * 10.0**-self.digits + SLACK
        for a, b, rows, scores in self.block.parts(unit, self.need - margin):
            scores = scores if self.digits is None else np.round(scores, self.digits)
            for q in range(a, b):
                mine = scores[:, q - a]
                good = np.flatnonzero((mine > 0) & (mine >= self.need[q]))
                if len(good) > 4 * self.k:
                    least = np.partition(mine[good], -self.k)[-self.k]
                    good = good[mine[good] >= least]
                if len(good):
                    kept = self.kept[q] + [(-s, ids[rows[i]]) for s, i in zip(mine[good].tolist(), good, strict=True)]
                    kept.sort()
                    self.kept[q] = kept[: self.k]
                    if len(kept) >= self.k:
                        self.need[q] = -self.kept[q][-1][0]

    def rows(self) -> list[tuple]:
        return [(q, i, -s) for q, kept in zip(self.block.ids, self.kept, strict=True) for s, i in kept]


def within(vectors: DataFrame, id_col: str, vector_col: str, references: DataFrame, label_col: str, reference_col: str, threshold: float, compared: Accumulator | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, label, score)`` of every vector and reference whose cosine is at least ``threshold`` (JN5, DET2), exact.

    As a vector's cosine with one of another length, a null, zero or non-finite one counts as 0, a threshold must be positive.
    ``compared`` adds up the pairs whose cosine was taken. The references are read when this is called.
    """
    if threshold <= 0:
        raise ValueError("a threshold must be positive")
    schema = _result(vectors, references, id_col, label_col, ("label", "id"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = None
    for block in blocks(references, label_col, reference_col, block_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for places, unit in unit_rows(batch.column(1)):
                    for b in shared.value:
                        if b.unit.shape[1] != unit.shape[1]:
                            continue
                        for first, _, rows, scores in b.parts(unit, np.full(len(b.ids), threshold)):
                            if compared is not None:
                                compared.add(scores.size)
                            found += [(b.ids[first + q], ids[places[rows[i]]], float(scores[i, q])) for i, q in zip(*np.nonzero(scores >= threshold), strict=True)]
                if found:
                    yield record_batch(found, schema)

        here = rows.mapInArrow(run, schema)
        out = here if out is None else out.union(here)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return out.select("id", "label", "score")


def clustered(vectors: DataFrame, id_col: str, vector_col: str, count: int = 256, partitions: int | None = None) -> DataFrame:
    """The vectors written in an order that keeps near ones together, so that whole batches fall to the bounds.

    ``count`` pivots are the vectors with the smallest hash of their id, one for each value of that hash's low bits.
    """
    buckets = F.pmod(F.xxhash64(id_col), F.lit(count))
    pivots = vectors.where(F.col(vector_col).isNotNull()).groupBy(buckets.alias("b")).agg(F.min_by(vector_col, F.xxhash64(id_col, F.lit(1))).alias("v")).select(F.col("v").cast("array<double>").alias("v")).collect()
    units = {}
    for _, unit in unit_rows(pa.array([p.v for p in pivots], pa.list_(pa.float64()))):
        units[unit.shape[1]] = unit
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.full(len(batch), -1, np.int32)
            for places, unit in unit_rows(batch.column(1)):
                if unit.shape[1] in units:
                    near[places] = (unit @ units[unit.shape[1]].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["id", "v", "near"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>, near int")
    n = [partitions] if partitions else []
    return materialize(rows.repartitionByRange(*n, "near", F.xxhash64("id")).sortWithinPartitions("near"), "clustered").select(F.col("id").alias(id_col), F.col("v").alias(vector_col))
