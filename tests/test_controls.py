"""Interval joins and controls against plain forms of the same rules."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import candidates, controls, intervals, placement, quantiles


def test_interval_join_finds_each_pair_once(spark):
    draw = random.Random(1)
    rows = lambda n: [(draw.choice("ab"), s, s + draw.choice([0, 1, 3, 40])) for s in (draw.randrange(-20, 60) for _ in range(n))]
    a, b = rows(60), rows(60) + [("a", 5, 45)] * 2
    want = collections.Counter((s, x, y, u, v, min(y, v) - max(x, u)) for s, x, y in a for t, u, v in b if s == t and x < y and u < v and x < v and u < y)
    of = lambda r: spark.createDataFrame(r, "s string, start long, end long")
    for width in (1, 7, 1000):
        got = intervals.overlapping(of(a), of(b), "s", width).select("s", "start", "end", "right_start", "right_end", "overlap")
        assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_touching_and_empty_intervals_do_not_meet(spark):
    a = spark.createDataFrame([("s", 0, 4), ("s", 6, 6), (None, 0, 9)], "s string, start long, end long")
    b = spark.createDataFrame([("s", 4, 8), (None, 0, 9)], "s string, start long, end long")
    assert intervals.overlapping(a, b, "s", 4).isEmpty()


def test_a_derangement_has_no_fixed_point_and_uses_all(spark):
    got = controls.deranged(spark.range(50), "id", 1).collect()
    assert {r["id"] for r in got} == {r["partner"] for r in got} == set(range(50))
    assert all(r["id"] != r["partner"] for r in got)
    assert [tuple(r) for r in controls.deranged(spark.range(1), "id", 1).collect()] == [(0, 0)]


def test_shuffled_groups_keep_their_sizes(spark):
    rows = [(i, "big") for i in range(3000)] + [(3000 + i, f"g{i % 7}") for i in range(40)] + [(4000, "one")]
    got = controls.shuffled_groups(spark.createDataFrame(rows, "id long, g string"), "id", "g", 2).collect()
    assert collections.Counter(r["g"] for r in got) == collections.Counter(r["shuffled"] for r in got)
    assert len({r["id"] for r in got}) == len(rows) and any(r["g"] != r["shuffled"] for r in got)


def test_redrawn_labels_follow_their_shares(spark):
    df = spark.range(4000).selectExpr("id", "case when id % 4 = 0 then 'a' else 'b' end as v")
    got = collections.Counter(r["redrawn"] for r in controls.redrawn(df, ["id"], "v", 3).collect())
    assert set(got) == {"a", "b"} and abs(got["a"] - 1000) < 120
    assert controls.redrawn(df.limit(0), ["id"], "v", 3).isEmpty()


def test_pairs_draw_small_groups_as_often_and_never_one_twice(spark):
    rows = [(i, "big") for i in range(500)] + [(1000, "two"), (1001, "two"), (2000, "alone")]
    df = spark.createDataFrame(rows, "id long, g string")
    got = controls.stratified_pairs(df, "id", "g", spark.range(2000).withColumnRenamed("id", "n"), "n", 4).collect()
    by = collections.Counter(r["g"] for r in got)
    group = dict(rows)
    assert set(by) == {"big", "two"} and sum(by.values()) == 2000 and abs(by["two"] - 1000) < 150
    assert all(r["left"] != r["right"] and group[r["left"]] == group[r["right"]] == r["g"] for r in got)


@pytest.mark.parametrize("rows", [4, 1_000_000])
def test_quantiles_are_numpys_in_any_ranges(spark, rows):
    draw = random.Random(7)
    data = [(draw.choice(["hot", "hot", "hot", "b", None]), draw.choice([None, *range(20)])) for _ in range(400)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(data, "g string, x long")
    got = {r["g"]: (r["a"], r["m"], r["z"]) for r in quantiles.linear(df, "g", "x", {"a": 0.0, "m": 0.37, "z": 1.0}, rows).collect()}
    groups = collections.defaultdict(list)
    for g, x in data:
        if x is not None:
            groups[g].append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, [0.0, 0.37, 1.0]))


def test_pools_keep_ties_by_ordinal_and_those_without_scores(spark):
    rows = [("p", i, float(i // 2)) for i in range(8)] + [("q", i, None) for i in range(5)] + [("r", 0, 1.0), ("r", 1, None)] + [("s", 0, None), ("s", 1, 2.0), ("s", 2, 3.0)]
    df = spark.createDataFrame(rows, "pool string, i long, x double")
    got = collections.defaultdict(list)
    for r in candidates.best_share(df, "pool", F.col("x"), "i", 0.25).orderBy("rank").collect():
        got[r["pool"]].append(r["i"])
    assert dict(got) == {"p": [6, 7], "q": [0, 1, 2, 3, 4], "r": [0, 1], "s": [2, 1]}


def test_turns_take_one_of_each_group(spark):
    df = spark.range(30).select(F.when(F.col("id") < 25, "big").otherwise("small").alias("g"), (-F.col("id")).alias("k"))
    for block in (3, 1000):
        got = {(r["g"], r["k"]): r["turn"] for r in placement.round_robin(df, "g", ["k"], block).collect()}
        assert got == {**{("big", -i): 24 - i for i in range(25)}, **{("small", -i): 29 - i for i in range(25, 30)}}
