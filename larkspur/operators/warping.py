"""Alignment of two series: banded time warping, shift between windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path(source: np.ndarray, target: np.ndarray, band: float) -> tuple[list[tuple[int, int]], float] | None:
    """The cheapest path from the first pair to the last by steps (1,1), (1,2) and
    (2,1), no pair farther from the diagonal than ``band`` of the target's length;
    none where these steps can't get there. Of equally cheap steps the first named."""
    n, m = len(source), len(target)
    if not n or not m:
        return None
    gap = np.abs(source[:, None] - target)
    scale = (m - 1) / max(n - 1, 1)
    gap[np.abs(np.arange(m) - np.arange(n)[:, None] * scale) > band * m] = np.inf
    cost, came = np.full((n, m), np.inf), np.zeros((n, m), dtype=int)
    cost[0, 0] = gap[0, 0]
    steps = ((1, 1), (1, 2), (2, 1))
    for i in range(1, n):
        before = np.full((3, m), np.inf)
        for s, (a, b) in enumerate(steps):
            if i >= a and m > b:
                before[s, b:] = cost[i - a, :-b]
        came[i] = before.argmin(axis=0)
        cost[i] = before.min(axis=0) + gap[i]
    if not np.isfinite(cost[-1, -1]):
        return None
    i, j, back = n - 1, m - 1, []
    while (i, j) != (0, 0):
        back.append((i, j))
        a, b = steps[came[i, j]]
        i, j = i - a, j - b
    return [(0, 0), *reversed(back)], float(cost[-1, -1])


def warped(source: Column, target: Column, band: float = 0.35) -> Column:
    """struct(pairs, cost) of the banded path between two arrays; null without one,
    and where either is null, empty or holds a null."""

    @F.pandas_udf("struct<pairs: array<struct<source: int, target: int>>, cost: double>")
    def found(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            bad = x is None or y is None
            x, y = (np.array([] if bad else v, dtype=float) for v in (x, y))
            got = None if np.isnan(x).any() or np.isnan(y).any() else path(x, y, band)
            out.append(([{"source": i, "target": j} for i, j in got[0]], got[1]) if got else (None, None))
        return pd.DataFrame(out, columns=["pairs", "cost"])

    got = found(source, target)
    return F.when(got["cost"].isNotNull(), got)


def detected_stride(first: Column, second: Column, tolerance: float) -> Column:
    """The least shift at which the second array goes on where the first stands: all
    that overlaps agrees within ``tolerance``; null if none does."""
    n = F.size(first)
    agrees = lambda s: F.forall(F.sequence(s + 1, n), lambda i: F.abs(F.element_at(first, i) - F.element_at(second, i - s)) <= tolerance)
    return F.when((n > 1) & (F.size(second) >= n), F.array_min(F.filter(F.sequence(F.lit(1), n - 1), agrees)))


def anchor_pairs(pairs: Column, most: float) -> Column:
    """Of anchor pairs struct(s, t) in order, those that a warp can hold: both rise,
    and the stretch from the last one kept is within ``most`` times either way.
    The first pair is always kept; an empty array stays empty."""
    last = lambda a: F.element_at(a, -1)
    ds, dt = (lambda a, x: x["s"] - last(a)["s"]), (lambda a, x: x["t"] - last(a)["t"])
    fits = lambda a, x: (ds(a, x) > 0) & (dt(a, x) > 0) & (dt(a, x) <= most * ds(a, x)) & (ds(a, x) <= most * dt(a, x))
    return F.when(F.size(pairs) > 0, F.aggregate(F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), F.slice(pairs, 1, 1), lambda a, x: F.when(fits(a, x), F.concat(a, F.array(x))).otherwise(a))).otherwise(pairs)


def through_anchors(pairs: Column, place: Column) -> Column:
    """Where a target's place lies in the source: linearly between the kept pairs
    around it; null outside them."""
    k = F.array_max(F.filter(F.sequence(F.lit(1), F.size(pairs) - 1), lambda i: F.element_at(pairs, i)["t"] <= place))
    a, b = F.element_at(pairs, k), F.element_at(pairs, k + 1)
    inside = (F.size(pairs) > 1) & k.isNotNull() & (place <= b["t"])
    return F.when(F.size(pairs) > 1, F.when(inside, a["s"] + (place - a["t"]) * (b["s"] - a["s"]) / (b["t"] - a["t"])))
