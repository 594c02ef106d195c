"""Draws and what chance would give: against NumPy and plain rules with the same draws."""

import hashlib
import math
import random
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import clusters, nulls, pools, stats


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


# --- pools -------------------------------------------------------------------

PAIRS = "id long, one array<double>, two array<double>, g string"


def pairs(spark, n, noise, groups=4, seed=7):
    rng = np.random.default_rng(seed)
    one = rng.normal(size=(n, 5))
    two = one + noise * rng.normal(size=(n, 5))
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), None if i % groups == 0 else str(i % groups)) for i, (a, b) in enumerate(zip(one, two, strict=True))], PAIRS)


def test_pools_report_their_spread(spark):
    df = pairs(spark, 120, 1.0)
    small = pools.precision_at_pool(df, "id", "one", "two", 20, 8).first()
    large = pools.precision_at_pool(df, "id", "one", "two", 100, 3).first()
    assert small == pools.precision_at_pool(df, "id", "one", "two", 20, 8).first()
    assert small["draws_scored"] == 8 and small["r_min"] <= small["r_mean"] <= small["r_max"] and small["r_std"] > 0
    assert small["r_mean"] > large["r_mean"] and small["chance_r"] > large["chance_r"]
    assert pools.precision_at_pool(pairs(spark, 40, 0.0), "id", "one", "two", 30, 2).first()["r_mean"] == 100.0
    assert pools.precision_at_pool(df, "id", "one", "two", 20, 2, group="g").first()["draws_scored"] == 2


def test_pools_that_cannot_be_drawn_or_scored(spark):
    df = pairs(spark, 20, 1.0)
    with pytest.raises(ValueError, match="cannot draw"):
        pools.precision_at_pool(df, "id", "one", "two", 50, 2)
    with pytest.raises(ValueError, match="cannot support"):
        pools.precision_at_pool(df, "id", "one", "two", 4, 2)
    with pytest.raises(Exception, match="could be scored"):
        pools.precision_at_pool(df.withColumn("g", F.lit("x")), "id", "one", "two", 10, 2, group="g").collect()


def test_each_pool_has_the_least_hashes(spark):
    df = pairs(spark, 60, 1.0)
    found = {}
    for r in pools.drawn(df, "id", 7, 3).collect():
        found.setdefault(r["draw"], set()).add(r["id"])
    assert found == {d: set(sorted(range(60), key=lambda i: sha(42, d, i))[:7]) for d in (1, 2, 3)}


# --- Frechet distance and swaps ----------------------------------------------


def plain_frechet(a, b):
    ca, cb = np.cov(a.T), np.cov(b.T)
    root = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    return ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root


@pytest.mark.parametrize("shift", [0.0, 0.4])
def test_swaps_are_those_of_numpy(spark, shift):
    rng = np.random.default_rng(3)
    arm, base, truth = rng.normal(size=(300, 4)), rng.normal(size=(300, 4)) + shift, rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(arm, base, strict=True))] + [(900, None, [0.0] * 4)], "id long, a array<double>, b array<double>")
    t = spark.createDataFrame([(x.tolist(),) for x in truth] + [(None,)], "v array<double>")
    got = stats.paired_swaps(df.repartition(5), "id", "a", "b", t, "v", 60).first()
    seen, null = plain_frechet(base, truth) - plain_frechet(arm, truth), []
    for r in range(1, 61):
        swap = np.array([sha(42, r, i)[0] < "8" for i in range(300)])[:, None]
        null.append(plain_frechet(np.where(swap, arm, base), truth) - plain_frechet(np.where(swap, base, arm), truth))
    null = np.array(null)
    assert abs(got["observed_delta"] - seen) < 1e-8 and abs(got["null_sd"] - null.std(ddof=1)) < 1e-8
    assert got["p_one_sided"] == ((null >= seen) if seen >= 0 else (null <= seen)).mean()
    assert shift == 0.0 or got["p_one_sided"] < 0.05
    assert abs(stats.frechet(df, t.withColumnRenamed("v", "a"), "a").first()[0] - plain_frechet(arm, truth)) < 1e-8


def test_sides_must_fit(spark):
    one = spark.createDataFrame([([1.0, 2.0],), ([2.0, 0.0],)], "v array<double>")
    with pytest.raises(ValueError, match="length"):
        stats.frechet(one, spark.createDataFrame([([1.0],)], "v array<double>"), "v")
    with pytest.raises(ValueError, match="length"):
        stats.frechet(one.limit(0), one, "v")
    with pytest.raises(Exception, match="fewer than two"):
        stats.frechet(one.limit(1), one, "v").collect()


# --- seeds of clusters -------------------------------------------------------


def plain_seeds(points, k, seed=42):
    chosen, d = [], np.zeros(len(points))
    for i in range(k):
        u = [(int(sha(seed, i, j)[:13], 16) + 0.5) / 2.0**52 for j in range(len(points))]
        order = [(d[j] <= 0, -math.log(u[j]) / d[j] if d[j] > 0 else u[j], j) for j in range(len(points))]
        chosen.append(min(order)[2])
        d = np.round(((points[:, None] - points[chosen][None]) ** 2).sum(-1), 6).min(1)
    return chosen


def test_seeds_and_settled_clusters(spark):
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 2], 40)
    points = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])[truth] + rng.normal(scale=0.2, size=(120, 2))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    seeds = clusters.squared_seeds(df, "id", "v", 3)
    assert [k for k, _ in seeds] == plain_seeds(points, 3) and len({truth[k] for k, _ in seeds}) == 3
    told = clusters.nearest(df, "v", clusters.kmeans(df, "id", "v", 3, 100, start=[x for _, x in seeds]))
    got = {r["id"]: r["assigned"] for r in told.collect()}
    assert all(len({got[i] for i in range(120) if truth[i] == g}) == 1 for g in range(3))
    # Copies: four places, four seeds.
    same = spark.createDataFrame([(i, [float(i % 4)]) for i in range(60)], "id long, v array<double>")
    assert {x[0] for _, x in clusters.squared_seeds(same, "id", "v", 4)} == {0.0, 1.0, 2.0, 3.0}
    assert len(clusters.squared_seeds(same, "id", "v", 6)) == 6
    with pytest.raises(ValueError, match="cannot form"):
        clusters.squared_seeds(same.limit(3), "id", "v", 5)


# --- spans and events laid out anew ------------------------------------------


def test_spans_keep_their_lengths_and_turn(spark):
    rng = random.Random(2)
    sequences = {"a": [rng.randint(1, 9) for _ in range(25)], "equal": [4] * 12, None: [3, 5], "one": [7]}
    rows = []
    for name, lengths in sequences.items():
        at = 10
        for n in lengths:
            rows.append((name, at, at + n))
            at += n
    df = spark.createDataFrame(rows, "seq string, start long, end long")
    found = {}
    for r in nulls.shuffled_spans(df, "seq", "start", "end", 6).collect():
        found.setdefault((r["seq"], r["round"]), set()).add(r["edge"])
    assert set(found) == {(s, r) for s in sequences for r in range(1, 7)}
    for (name, r), edges in found.items():
        own = [x for x in rows if x[0] == name]
        span = sum(sequences[name])
        order = sorted(own, key=lambda x: sha(42, r, "null" if name is None else name, x[1]))
        turn = int(sha(42, "turn", r, "null" if name is None else name)[:12], 16) % span
        offsets = np.cumsum([b - a for _, a, b in order])[:-1]
        assert edges == {10, 10 + span} | {10 + int((o + turn) % span) for o in offsets}
    assert any(found["equal", r] != set(range(10, 59, 4)) for r in range(1, 7))


def test_events_keep_their_gaps(spark):
    rng = random.Random(5)
    events = {"a": sorted(rng.sample(range(100), 20)), "single": [3], "one frame": [0], None: [1, 2, 9]}
    sizes = {"a": 100, "single": 50, "one frame": 1, None: 30}
    df = spark.createDataFrame([(s, f) for s, fs in events.items() for f in fs], "seq string, frame long")
    n = spark.createDataFrame(list(sizes.items()), "seq string, n long")
    found = {}
    for r in nulls.shuffled_events(df, "seq", "frame", n, "n", 4).collect():
        found.setdefault((r["seq"], r["round"]), []).append(r["frame"])
    assert len(found) == 16
    for (name, _), laid in found.items():
        if name in ("single", "one frame"):
            assert laid == events[name]
            continue
        # Around the circle the gaps are the same ones, but for the one over the open end.
        size, laid = sizes[name], sorted(laid)
        around = sorted([b - a for a, b in pairwise(laid)] + [laid[0] + size - laid[-1]])
        assert around == sorted([b - a for a, b in pairwise(events[name])] + [events[name][0] + size - events[name][-1]])
    assert len({tuple(sorted(x)) for (s, _), x in found.items() if s == "a"}) == 4


def test_random_points_and_their_distances(spark):
    n = spark.createDataFrame([("a", 60, 7), ("few", 6, 99), ("none", 50, 0), ("short", 3, 2), (None, 40, 3)], "seq string, n long, k long")
    points = nulls.random_points(n, "seq", "n", "k", 3)
    found = {}
    for r in points.collect():
        found.setdefault((r["seq"], r["draw"]), set()).add(r["frame"])
    for (name, draw), frames in found.items():
        size, k = {"a": (60, 7), "few": (6, 99), None: (40, 3)}[name]
        key = "null" if name is None else name
        assert frames == set(sorted(range(1, size - 1), key=lambda f: sha(42, draw, key, f))[:k])
    assert len(found) == 9
    cuts = spark.createDataFrame([("a", 5), ("a", 59), (None, 20), ("none", 4)], "seq string, frame long")
    got = {(r["seq"], r["draw"], r["frame"]): r["distance"] for r in nulls.point_distances(cuts, points, "seq", "frame", "draw").collect()}
    want = {(s, d, f): min(abs(f - x) for x in found[s, d]) for s, f in (("a", 5), ("a", 59), (None, 20)) for d in (1, 2, 3)}
    assert got == want


def test_turns_against_numpy(spark):
    rng = np.random.default_rng(1)
    sizes = {"a": 80, "b": 30, "one": 1, None: 25}
    events = {"a": rng.choice(80, 12, replace=False), "b": np.array([2, 9]), "one": np.array([0]), None: np.arange(0, 25, 5)}
    masks = {"a": rng.choice(80, 20, replace=False), "b": np.array([], int), "one": np.array([0]), None: np.arange(0, 25, 5)}
    frame = lambda d: spark.createDataFrame([(s, int(x)) for s, xs in d.items() for x in xs], "seq string, frame long")
    got = {r["seq"]: r for r in nulls.shift_null(frame(events), frame(masks), spark.createDataFrame(list(sizes.items()), "seq string, n long"), "seq", "frame", "n", 15).collect()}
    for name, n in sizes.items():
        mask = np.zeros(n, bool)
        mask[masks[name]] = True
        seen = round(float(mask[events[name]].mean()), 9)
        assert got[name]["observed"] == seen and got[name]["events"] == len(events[name])
        if n == 1:
            assert got[name]["p"] is None
            continue
        key = "null" if name is None else name
        rates = [round(float(mask[(events[name] + 1 + int(sha(42, r, key)[:12], 16) % (n - 1)) % n].mean()), 9) for r in range(1, 16)]
        assert abs(got[name]["null_mean"] - np.mean(rates)) < 1e-9 and abs(got[name]["null_sd"] - np.std(rates)) < 1e-9
        assert got[name]["p"] == (sum(x >= seen for x in rates) + 1) / 16
