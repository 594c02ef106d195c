"""Placement, clusters and alignment against plain forms of the same rules."""

import functools
import random

import numpy as np
import pytest

from larkspur.operators import candidates, clusters, splits, warping
from larkspur.session import TABLES
from larkspur.sources import views
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("masses", [[1] * 300, [7] * 3 + [5] * 50 + [1] * 90 + [0] * 4, [100, 1, 1, 1], [3]])
def test_largest_deficit_is_the_step_by_step_rule(spark, masses):
    draw = random.Random(len(masses))
    masses = draw.sample(masses, len(masses))
    shares = {"train": 8, "val": 1, "test": 1}
    left, want = {s: k * sum(masses) for s, k in shares.items()}, {}
    for i, m in sorted(enumerate(masses), key=lambda x: (-x[1], x[0])):
        to = max(shares, key=lambda s: (left[s], s))
        want[i], left[to] = to, left[to] - 10 * m
    got = splits.largest_deficit(spark.createDataFrame(list(enumerate(masses)), "g long, m long"), "g", "m", shares)
    assert {r["g"]: r["split"] for r in got.collect()} == want


def test_an_oversize_group_is_train_and_does_not_count(spark):
    df = spark.createDataFrame([("big", 900)] + [(f"g{i}", 1) for i in range(100)], "g string, m long")
    got = {r["g"]: r["split"] for r in splits.guarded_fill(df, "g", "m", {"test": 1, "val": 1}, 100, 0.5).collect()}
    assert got["big"] == "train" and [sum(v == s for v in got.values()) for s in ("test", "val", "train")] == [10, 10, 81]


def test_a_lost_centre_starts_again_at_the_farthest_row(spark):
    rows = [(i, [0.0]) for i in range(5)] + [(9, [10.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    told = clusters.nearest(df, "v", clusters.kmeans(df, "id", "v", 2, 4))
    got = {r["id"]: r["assigned"] for r in told.collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[9] != got[0]


def test_fewer_rows_than_centres_and_none(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert clusters.kmeans(df, "id", "v", 3, 2).count() == 1
    assert clusters.kmeans(df.filter("id < 0"), "id", "v", 3, 2).count() == 0


def test_merging_of_centres_takes_the_cheapest_pair_each_time(spark):
    draw = np.random.default_rng(3)
    at, n = draw.normal(size=(14, 3)), draw.integers(1, 9, 14)
    groups = [[i] for i in range(14)]

    def spread(members):
        mean = np.average(at[members], axis=0, weights=n[members])
        return (n[members] * ((at[members] - mean) ** 2).sum(1)).sum()

    while len(groups) > 4:
        pairs = [(spread(a + b) - spread(a) - spread(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    want = {frozenset(g) for g in groups}
    df = spark.createDataFrame([(i, at[i].tolist(), int(n[i])) for i in range(14)], "label int, center array<double>, n long")
    found = {}
    for r in clusters.merge_centers(df, 4).collect():
        found.setdefault(r["merged"], set()).add(r["label"])
    assert {frozenset(g) for g in found.values()} == want and set(found) == {1, 2, 3, 4} and 0 in found[1]


def test_warping_against_all_paths(spark):
    draw = np.random.default_rng(5)
    for n, m in ((6, 6), (5, 8), (8, 5), (1, 1), (7, 6)):
        a, b = draw.normal(size=n), draw.normal(size=m)
        inside = lambda i, j: abs(j - i * ((m - 1) / max(n - 1, 1))) <= 0.5 * m  # noqa: B023, E731

        @functools.cache
        def least(i, j):
            if i < 0 or j < 0 or not inside(i, j):  # noqa: B023
                return np.inf
            before = 0 if (i, j) == (0, 0) else min(least(i - x, j - y) for x, y in ((1, 1), (1, 2), (2, 1)))  # noqa: B023
            return before + abs(a[i] - b[j])  # noqa: B023

        pairs, cost = warping.path(a, b, 0.5)
        assert abs(cost - least(n - 1, m - 1)) < 1e-9 and abs(sum(abs(a[i] - b[j]) for i, j in pairs) - cost) < 1e-9
        assert pairs[0] == (0, 0) and pairs[-1] == (n - 1, m - 1)
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0] * 2, [1.0] * 9), (None, [1.0]), ([], [1.0]), ([None], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(warping.warped(F.col("a"), F.col("b"))).collect()]
    assert got[0]["cost"] == 0 and got[1:] == [None] * 4


def test_the_least_shift_that_agrees(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 3.0, 9.0]), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), ([1.0, 2.0], [5.0, 6.0]), ([1.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(warping.detected_stride(F.col("a"), F.col("b"), 0.0)).collect()] == [1, 1, None, None]


def test_pools_keep_two_and_small_or_unscored_ones_stay(spark):
    rows = [("a", i, float(i)) for i in range(8)] + [("b", 1, 1.0), ("b", 2, 2.0)] + [("c", i, None) for i in range(5)] + [("d", i, 0.0) for i in range(3)]
    kept = candidates.best_share(spark.createDataFrame(rows, "p string, o int, s double"), "p", F.col("s"), "o", 0.25)
    found = {}
    for r in kept.collect():
        found.setdefault(r["p"], set()).add(r["o"])
    assert found == {"a": {6, 7}, "b": {1, 2}, "c": set(range(5)), "d": {0, 1}}


def test_views_and_functions(spark):
    views.register(spark, SF)
    assert {t.name for t in spark.catalog.listTables()} >= set(TABLES)
    got = spark.sql("SELECT overlap(1, 5, 3, 9), overlap(1, 2, 3, 4), phase(1.5D, 1D, 2D), phase(1D, 1D, 1D), upload_key('a:b:c'), mm_ss(75)").first()
    assert tuple(got) == (2, 0, 0.5, None, "c", "01:15")


def test_small_groups_join_the_nearest_sibling_smallest_first(spark):
    rows = [(1, 10, [0.0], 1), (1, 11, [1.0], 2), (1, 12, [5.0], 9), (1, 13, [1.4], 3), (2, 20, [0.0], 1), (3, 30, [0.0], 5), (3, 31, [0.0], 5)]
    df = spark.createDataFrame(rows, "p int, label int, center array<double>, n long")
    got = {r["label"]: r["merged"] for r in clusters.merge_small(df, "p", 5).collect()}
    # 10 joins 11; of 11 and 13 with three rows each 11 goes first, to 13, which then has six.
    assert got == {10: 13, 11: 13, 12: 12, 13: 13, 20: 20, 30: 30, 31: 31}


def test_anchors_must_rise_and_keep_the_stretch(spark):
    pairs = [(0, 0), (0, 8), (10, 16), (100, 24), (19, 24)]
    df = spark.createDataFrame([(pairs,), ([],)], "p array<struct<s: long, t: long>>")
    kept = df.select(warping.anchor_pairs(F.col("p"), 1.6).alias("k"))
    assert [[tuple(x) for x in r["k"]] for r in kept.collect()] == [[(0, 0), (10, 16), (19, 24)], []]
    at = [warping.through_anchors(F.col("k"), F.lit(x)) for x in (8, 16, 24, 25)]
    assert [tuple(r) for r in kept.select(*at).collect()] == [(5.0, 10.0, 19.0, None), (None,) * 4]
