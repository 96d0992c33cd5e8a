"""Embedding near-duplicates by lattice hashing with E8 cells.

In each of several tables a vector's unit direction is projected at random to ``blocks`` times 8 dimensions
and each 8 are decoded to the nearest point of the E8 lattice; the points together name a cell. A vector is filed in its own
(home) cell and looked up in the ``probes`` neighbouring cells nearest to it, offsets being the lattice's 240 least
vectors. Vectors that share a cell, one of them at home, are compared by cosine in double precision.

The lattice's fineness follows the number of vectors (``settings_for``), so a cell holds a few strangers at any
size, while a pair at cosine 0.95 shares a cell in some table with a probability of 0.999 (measured in the tests).

Only class numbers travel to the cells first; a vector follows for the cells in which it has company, so the
many cells with one member cost no vector.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import discard, materialize, paired_blocks
from memlayer.llm.components import components

LEAST = 0.95
#: (vectors, tables, blocks, probes, scale): settings for up to so many vectors; each finds 0.999 of the pairs at cosine 0.95.
LEVELS = ((20_000, 7, 2, 6, 3.8), (200_000, 10, 2, 6, 4.6), (5_000_000, 10, 3, 12, 3.8), (1 << 62, 21, 4, 12, 3.8))
#: Vectors of one cell that meet in one task.
BLOCK = 2048
#: Cells of up to so many members are compared together, larger ones one by one.
SMALL = 48
#: Numbers that the vectors of one strip of pairs hold.
STRIP = 1 << 21


def settings_for(n: int) -> tuple[int, int, int, float]:
    """(tables, blocks, probes, scale) for ``n`` vectors."""
    return next(level[1:] for level in LEVELS if n <= level[0])


def decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(x[odd] - r[odd]).argmax(axis=1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integer points of even sum, or those moved by a half."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=1)
def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


class Hasher:
    """Cells of unit vectors of one dimension.

    Projections are scaled with the square root of the dimension, so the distance of a pair at a given cosine is the same within
    each 8 projected dimensions whatever the vectors' own dimension.
    """

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int = 1) -> None:
        r = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.maps = []
        for _ in range(tables):
            m = r.normal(size=(dim, 8 * blocks))
            m = np.linalg.qr(m)[0] if dim >= 8 * blocks else m / np.sqrt(dim)
            self.maps.append(m * scale * np.sqrt(dim / 64))
        self.odd = r.integers(1 << 62, size=8).astype(np.uint64) | np.uint64(1)
        # which offset each block takes: 0 none, else one of its nearest neighbours; two blocks at most move
        self.options = np.array([o for o in itertools.product(range(4), repeat=blocks) if sum(x > 0 for x in o) < 3])

    def _name(self, points: np.ndarray) -> np.ndarray:
        """A hash of lattice points (..., 8)."""
        n = np.full(points.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        twice = (2 * points).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.odd):
                n = (n ^ twice[..., k]) * odd
                n ^= n >> np.uint64(29)
        return n

    def cells(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the home cell, then the neighbours, nearest first."""
        out = np.zeros((len(units), self.tables, 1 + self.probes), np.int64)
        rows = np.arange(len(units))[:, None]
        for t, m in enumerate(self.maps):
            x = units @ m
            total, names = np.zeros((len(x), len(self.options))), []
            for b in range(self.blocks):
                part = x[:, 8 * b : 8 * b + 8]
                home = decode_e8(part)
                gain = 2.0 - 2.0 * ((part - home) @ least_vectors().T)
                near = np.argpartition(gain, 2, axis=1)[:, :3]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(gain, near, axis=1), axis=1, kind="stable"), axis=1)
                names.append(self._name(np.concatenate([home[:, None], home[:, None] + least_vectors()[near]], axis=1)))
                total += np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(gain, near, axis=1)], axis=1)[:, self.options[:, b]]
            total[:, 0] = -1.0
            best = np.argsort(total, axis=1, kind="stable")[:, : 1 + self.probes]
            name = np.full(best.shape, (t + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            with np.errstate(over="ignore"):
                for b in range(self.blocks):
                    name = (name ^ names[b][rows, self.options[best, b]]) * np.uint64(0xD6E8FEB86659FD93)
                    name ^= name >> np.uint64(32)
            out[:, t] = name.view(np.int64)
        return out


@lru_cache(maxsize=8)
def _hasher(dim: int, settings: tuple) -> Hasher:
    return Hasher(dim, *settings)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows over their norms, safe for very large and very small numbers."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _file(classes: DataFrame, settings: tuple) -> DataFrame:
    """``(cid, vector)`` -> one row for each cell a vector is filed or looked up in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(size):
                mine = batch.take(pa.array(np.flatnonzero(size == dim)))
                for at in range(0, mine.num_rows, 512):
                    part = mine.slice(at, 512)
                    cells = _hasher(int(dim), settings).cells(_units(_matrix(part.column(1))))
                    k, t, p = cells.shape
                    table = np.tile(np.repeat(np.arange(t), p), k).astype(np.int32)
                    home = np.tile(np.arange(p) == 0, k * t)
                    yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(cells.ravel()), pa.array(home), part.column(0).take(pa.array(np.repeat(np.arange(k), t * p)))], names=["t", "cell", "home", "cid"])

    return classes.select("cid", "vector").mapInArrow(run, "t int, cell long, home boolean, cid long")


def _strips(first: np.ndarray, size: np.ndarray, units: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members (a < b) that may reach ``least``, from groups of members that follow each other."""
    strip = max(1, STRIP // units.shape[1])
    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(n, 1)
        heads = first[size == n]
        step = max(1, strip // len(i))
        for at in range(0, len(heads), step):
            some = heads[at : at + step, None]
            a, b = (some + i).ravel(), (some + j).ravel()
            near = np.einsum("ij,ij->i", units[a], units[b]) >= least - 1e-9
            yield a[near], b[near]
    for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = max(1, (1 << 18) // n)
        for at in range(lo, lo + n, rows):
            a, b = np.nonzero(units[at : min(at + rows, lo + n)] @ units[at : lo + n].T >= least - 1e-9)
            a, b = a + at, b + at
            for k in range(0, len(a), strip):
                x, y = a[k : k + strip], b[k : k + strip]
                yield x[x < y], y[x < y]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the classes of linked members; ``root`` holds each member's least one, fully followed."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == (up := root[root])).all():
            root[:] = up


def _compare(group: dict[str, np.ndarray], vectors: np.ndarray, least: float, settings: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Each member's root and number of links, in groups of members that follow each other.

    A pair counts where it is met first: in the lowest table in which it shares a cell, there in the cell
    with the lower name, and for two vectors of one block in that block's first part. Pairs come in strips of bounded size and
    are never held all at once.
    """
    first = np.flatnonzero(np.r_[True, group["part"][1:] != group["part"][:-1]])
    size = np.diff(np.r_[first, len(vectors)])
    units, home, own, n = _units(vectors), group["home"], group["own"], group["n"]
    root, links = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    kinds, which = np.unique(group["cid"], return_inverse=True)
    sample = np.zeros(len(kinds), np.int64)
    sample[which] = np.arange(len(vectors))
    known, place = np.zeros((0, settings[0], 1 + settings[2]), np.int64), np.full(len(kinds), -1)
    hasher, top = _hasher(vectors.shape[1], settings), np.iinfo(np.int64).max
    for a, b in _strips(first, size, units, least):
        met = home[a] | home[b]
        a, b = a[met], b[met]
        if not len(a):
            continue
        va, vb = vectors[a], vectors[b]
        with np.errstate(all="ignore"):
            exact = (va * vb).sum(axis=1) / (np.sqrt((va * va).sum(axis=1)) * np.sqrt((vb * vb).sum(axis=1)))
        ok = np.where(np.isfinite(exact) & (exact != 0), exact, (units[a] * units[b]).sum(axis=1)) >= least
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        _join(root, a, b)
        # the cells of all vectors met so far, each computed once
        new = np.unique(which[np.concatenate([a, b])])
        new = new[place[new] < 0]
        if len(new):
            place[new] = len(known) + np.arange(len(new))
            known = np.concatenate([known, hasher.cells(units[sample[new]])])
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            p, q = known[place[which[x]]], known[place[which[y]]]
            table = np.concatenate([p[:, :, :1] == q, p == q[:, :, :1]], axis=2).any(axis=2).argmax(axis=1)
            p, q = (np.take_along_axis(c, table[:, None, None], axis=1)[:, 0] for c in (p, q))
            lowest = np.minimum(np.where(p[:, :1] == q, q, top).min(axis=1), np.where(p == q[:, :1], p, top).min(axis=1))
            here = (table == group["t"][x]) & (lowest == group["cell"][x])
            # of one block: in the part with the lowest other block
            mine, i, j = own[x], group["i"][x], group["j"][x]
            other = np.where(mine == 0, 1, 0)
            here &= (i == j) | (mine != own[y]) | ((np.minimum(mine, other) == i) & (np.maximum(mine, other) == j))
            np.add.at(links, x[here], n[y[here]])
            np.add.at(links, y[here], n[x[here]])
    return root, links


_MEMBER = ("part", "t", "cell", "_i", "_j", "cid", "home", "_own", "n")


def _found(batch: pa.RecordBatch, least: float, settings: tuple) -> Iterator[pa.RecordBatch]:
    vector = batch.column(batch.num_columns - 1)
    size = np.diff(vector.offsets.to_numpy())
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        mine = batch.take(pa.array(at))
        group = {name.lstrip("_"): mine.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(_MEMBER)}
        root, links = _compare(group, _matrix(mine.column(mine.num_columns - 1)), least, settings)
        some = (root != np.arange(len(root))) | (links > 0)
        if some.any():
            cid = group["cid"]
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root][some]), pa.array(links[some])], names=["a", "b", "links"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut where the first column changes, in batches that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        last = int(np.searchsorted(part, part[-1]))  # parts rise
        if held and held[-1].column(0)[-1].as_py() == part[0] and last == 0:
            held.append(batch)
            continue
        yield _one([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if any(b.num_rows for b in batches) else batches[0]


def lattice_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, settings: tuple[int, int, int, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Equal vectors are one class, filed once with their number; they are linked with each other (cosine 1). Classes have
    numbers of their own, so rows that repeat an id, or have none, count one by one. Vectors that are null, empty, zero, or hold
    a null or non-finite component link with nothing and are their own component, as are vectors of another dimension for each
    other. ``component_id`` is the smallest id among the rows reached; a null id never names a component (such a row is
    not kept), and a component of null ids has a null one. Hot cells are split into pairs of blocks. ``settings`` are
    (tables, blocks, probes, scale), by default those for the number of classes. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable: Column = F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    settings = settings or settings_for(classes.count())
    filed = materialize(_file(classes, settings), "cells")
    member = F.struct("cid", "home", "_own")
    parts = paired_blocks(filed, ["t", "cell"], "cid", block).groupBy("t", "cell", "_i", "_j").agg(F.collect_list(member).alias("m"))
    parts = materialize(parts.where((F.size("m") > 1) & F.exists("m", lambda x: x["home"])).withColumn("part", F.monotonically_increasing_id()), "parts")
    discard(filed)
    members = parts.select("part", "t", "cell", "_i", "_j", F.explode("m").alias("m")).select("part", "t", "cell", "_i", "_j", "m.*")
    members = members.join(classes.select("cid", "n", "vector"), "cid").select(*_MEMBER, "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            yield from _found(batch, least, settings)

    partial = materialize(members.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long, links long"), "links")
    discard(parts)
    named = components(partial.select("a", "b"))
    counted = partial.groupBy("a").agg(F.sum("links").alias("links"))
    own = classes.join(counted, classes.cid == counted.a, "left").join(named, classes.cid == named.id, "left")
    own = own.select("vector", "rep", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    least_id = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = own.join(least_id, "component").select("vector", "n_links", "component_id")
    found = rows.where("vector is not null").join(own, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
