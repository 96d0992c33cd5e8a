"""Relevance scorers: column builders over a base score (the hit's, or 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlayer.functions.text import column, path_depth, path_parts


def no_decay(score: Column | str) -> Column:
    """SCO1."""
    return F.coalesce(column(score).cast("double"), F.lit(1.0))


def temporal_decay(score: Column | str, active_at: Column | str, now: Column, half_life_seconds: int) -> Column:
    """Halves with each half-life of age in whole seconds; the future counts as now (SCO2, SF9)."""
    age = F.greatest(F.timestamp_diff("SECOND", column(active_at), now), F.lit(0))
    return no_decay(score) * F.exp(-F.log(F.lit(2.0)) * age / float(max(half_life_seconds, 1)))


def order_decay(score: Column | str, order: Column | str, current: Column | None, per_step: float) -> Column:
    """Falls by a share for each step from the current place; no current place is no distance (SCO3, WIN11)."""
    steps = F.lit(0) if current is None else F.coalesce(F.abs(current - column(order)), F.lit(0))
    return F.greatest(F.lit(0.0), no_decay(score) * (1 - F.lit(min(max(per_step, 0.0), 1.0)) * steps))


def path_proximity(a: Column | str, b: Column | str, strict: bool = False) -> Column:
    """Shared leading components over the greater depth (SCO5).

    By default empty components count in the shared part and not in the depth, so siblings under an absolute path are
    at 1; ``strict`` leaves them out of both.
    """
    a, b = column(a), column(b)
    x, y = path_parts(a), path_parts(b)
    if strict:
        x, y = (F.filter(p, lambda c: c != "") for p in (x, y))
    same = F.zip_with(x, y, lambda p, q: p.isNotNull() & q.isNotNull() & (p == q))
    at = F.array_position(same, False)
    shared = F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)
    depth = F.greatest(path_depth(a), path_depth(b), F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(shared.cast("double") / depth)


def location_proximity(a: Column, b: Column, strict: bool = False) -> Column:
    """Of two location structs: files by path; custom ones 1 within a schema; else 0 (SCO6)."""
    both = lambda kind: (a["kind"] == kind) & (b["kind"] == kind)
    files = path_proximity(a["path"], b["path"], strict)
    return F.when(both("file"), files).when(both("custom") & (a["schema"] == b["schema"]), F.lit(1.0)).otherwise(F.lit(0.0))


def file_proximity(score: Column | str, candidate: Column, current: Column | None, weight: float = 1.0, proximity: Column | None = None) -> Column:
    """Blend with proximity; without a current location the base stays, without the candidate's it counts as far (SCO4)."""
    base, w = no_decay(score), min(max(weight, 0.0), 1.0)
    if current is None:
        return base
    near = location_proximity(candidate, current) if proximity is None else proximity
    return F.when(candidate.isNull(), base * (1 - w)).otherwise(base * ((1 - w) + w * near))


def composite(score: Column | str, children: list[tuple[Column, float]]) -> Column:
    """The weighted mean of scorers; none gives the hit's score or 0, no positive weight gives 0 (SCO7)."""
    if not children:
        return F.coalesce(column(score).cast("double"), F.lit(0.0))
    total = float(sum(w for _, w in children))
    if total <= 0:
        return F.lit(0.0)
    out = F.lit(0.0)
    for c, w in children:
        out = out + c * float(w)
    return out / total
