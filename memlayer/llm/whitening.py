"""Embedding whitening by matrix-free block subspace iteration.

No covariance matrix is formed: a Spark pass multiplies it with a block of directions, as Xᵀ(XQ) over centred rows summed by
partial aggregation, so a task holds a batch of rows and two narrow matrices. The driver keeps the subspace of the last blocks
with their products (numbers by dimension, whatever the number of rows), orthogonalises by QR and takes Rayleigh-Ritz
pairs. The residuals of the wanted pairs are the next block, until all of them are at rounding level; a last pass over the
rows measures the true residuals and the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import materialize

COMPONENTS = 8
#: Directions of a pass beyond the wanted ones, and blocks kept before the subspace shrinks to its best ones.
EXTRA = 8
BLOCKS = 8
#: Residuals over the greatest eigenvalue at which the search ends, and that the last pass has to confirm.
TOLERANCE = 1e-12
CERTIFIED = 1e-9
#: Eigenvalues below this part of the greatest are rounding: they make no component.
LEAST = 1e-9
PASSES = 200
#: Entries as whole numbers: floor(1024 c) + 100000.
SCALE, SHIFT = 1024.0, 100_000


class Fit(NamedTuple):
    """Rows, their sums by dimension, unit directions (a column each), eigenvalues, trace, and the measured errors."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: the rows whose vector is neither null nor holds a null or non-finite entry, entries as whole numbers.

    Of vectors that differ in length those of the commonest length stay (of equally common ones the longest).
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & whole & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = materialize(rows.select("vec_id", x.alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (sizes["size"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``of(batch)``, ``size`` numbers; partitions send one sum each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(matrix(batch.column(0))).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["at", "part"])

    found = rows.select("x").mapInArrow(run, f"at long, part {kind}").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else float)
    for at, part in found:
        out[at] = part
    return out


def orthonormal(block: np.ndarray, against: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of what the columns hold beyond ``against``; columns that lie in it are left out."""
    length = np.linalg.norm(block, axis=0)
    block = block[:, length > 0] / length[length > 0]
    for _ in range(3):
        block = block - against @ (against.T @ block)
        q, r = np.linalg.qr(block)
        keep = np.abs(np.diag(r)) > least
        block, least = q[:, keep], 0.5
    return block


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, count: int, extra: int = EXTRA, blocks: int = BLOCKS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``count`` leading eigenpairs of a symmetric matrix known by its products alone: directions, values, passes."""
    width = min(dim, count + extra)
    block = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, width)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for passes in range(1, PASSES + 1):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:width], turns[:, ::-1][:, :width]
        ritz, moved = basis @ turns, image @ turns
        rest = moved - ritz * values
        top = max(values[0], 0.0)
        far = np.linalg.norm(rest, axis=0) > tolerance * top
        if not far[:count].any() or basis.shape[1] >= dim:
            return ritz[:, :count], values[:count], passes
        if basis.shape[1] + width > blocks * width:
            basis, image = ritz, moved
        block = orthonormal(rest[:, far], basis)
        if not block.shape[1]:
            return ritz[:, :count], values[:count], passes
        block = block[:, : dim - basis.shape[1]]
    raise RuntimeError(f"no {count} components certified after {PASSES} passes")


def fit(rows: DataFrame, count: int = COMPONENTS) -> Fit | None:
    """Fit on all of ``rows(x)``, vectors of one length; None if there are none."""
    head = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, dim = head[0], head[1]
    if not n:
        return None
    sums = _summed(rows, lambda x: x.sum(axis=0), dim, "long")
    # n x - S is a whole number, so centring loses nothing
    centred = lambda x: (n * x - sums) / n
    trace = float(_summed(rows, lambda x: np.array([np.square(centred(x)).sum()]), 1)[0]) / n
    if trace <= 0:
        return Fit(n, sums.tolist(), np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0.0)

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(rows, part, q.size).reshape(q.shape) / n

    directions, values, _ = leading(product, dim, min(count, dim))
    kept = values > LEAST * values[0]
    directions, values = directions[:, kept], values[kept]
    directions = directions / np.linalg.norm(directions, axis=0)
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    k = len(values)

    def check(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        y = c @ directions / np.sqrt(values)
        return np.concatenate([(c.T @ (c @ directions)).ravel(), (y.T @ y).ravel(), y.sum(axis=0)])

    seen = _summed(rows, check, dim * k + k * k + k) / n
    residual = float(np.linalg.norm(seen[: dim * k].reshape(dim, k) - directions * values, axis=0).max() / values[0])
    if residual > CERTIFIED:
        raise RuntimeError(f"residual {residual} over {CERTIFIED}")
    mean = seen[dim * k + k * k :]
    error = float(np.abs(seen[dim * k : dim * k + k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return Fit(n, sums.tolist(), directions, values, trace, residual, error)


def deviation(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """The sums of (n x - S)² by row, exact; None where one exceeds a long."""
    d = n * x - sums
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return np.square(d).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [s if s < 1 << 63 else None for s in exact]


def whiten(rows: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened rows: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each component.

    Components are numbered from 1 by falling eigenvalue; of the two unit directions the one whose largest entry is positive
    is taken. There are at most ``count``, at most the dimension, and none whose eigenvalue is rounding (under 1e-9 of the
    greatest): equal rows, or a single one, have none. Rows that repeat count each time; null ids stay. Rows with a null
    vector, a null or non-finite entry, no entry, or another length than the commonest are left out. A deviation that exceeds a
    long is null. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    data = quantised(rows, id_col, vector_col)
    model = fit(data, count)
    schema = "deviation long, whitened array<double>"
    id_type = data.schema["vec_id"].dataType.simpleString()
    if model is None:
        out = data.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where("false")
        model = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0, 0.0)
    else:
        n, sums, scaled = model.n, np.array(model.sums, np.int64), model.directions / np.sqrt(model.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column(1))
                    white = ((n * x - sums) / n) @ scaled
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * scaled.shape[1]), pa.array(white.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation(x, sums, n), pa.int64()), cells], names=["vec_id", "deviation", "whitened"])

        out = data.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, {schema}")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
