"""Left-to-right rules in blocks of any size against the plain folds."""

import math
import random

import pytest

from larkspur.operators import candidates, folds


def plain_snap(bounds, beats, max_snap, min_length):
    out, moved, legal = [bounds[0]], [False], [True]
    for i in range(1, len(bounds) - 1):
        cut = bounds[i]
        low = max(out[-1] + min_length, cut - max_snap)
        high = min(bounds[-1] - (len(bounds) - 1 - i) * min_length, cut + max_snap)
        window = {b: w for b, w in beats.items() if low <= b <= high}
        if high < low:
            target = max(cut, out[-1] + min_length)
        elif not window:
            target = min(max(cut, low), high)
        else:
            most = max(window.values())
            target = min((b for b in window if window[b] == most), key=lambda b: (abs(b - cut), b))
        fine = high >= low and bool(window)
        out.append(target)
        legal.append(fine)
        moved.append(fine and target != cut)
    if len(bounds) > 1:
        out, moved, legal = [*out, bounds[-1]], [*moved, False], [*legal, True]
    return out, moved, legal


@pytest.mark.parametrize("block", [1, 7, 4_096])
@pytest.mark.parametrize("weighted", [False, True])
def test_snapping_is_the_plain_fold(spark, block, weighted):
    rng = random.Random(block)
    bounds, beats = {}, {}
    for name in ("a", "b", None, "ends only", "one", "no beats"):
        at, own = 0, [0]
        for _ in range({"ends only": 1, "one": 0}.get(name, 25)):
            at += rng.choice([3, 3, 4, 5, 9, 14])
            own.append(at)
        bounds[name] = own
        beats[name] = {} if name == "no beats" else {rng.randrange(at + 1): float(rng.randrange(3)) if weighted else 0.0 for _ in range(60)}
    cuts = spark.createDataFrame([(s, c) for s, cs in bounds.items() for c in cs], "seq string, frame long")
    marks = spark.createDataFrame([(s, b, w) for s, bs in beats.items() for b, w in bs.items()], "seq string, frame long, w double")
    found = {}
    for r in folds.snap_cuts(cuts, marks, "seq", "frame", 4, 3, "w" if weighted else None, block).orderBy("nth").collect():
        found.setdefault(r["seq"], []).append((r["snapped"], r["moved"], r["legal"]))
    for name, own in bounds.items():
        assert found[name] == list(zip(*plain_snap(own, beats[name], 4, 3), strict=True)), name
        snapped = [x[0] for x in found[name]]
        assert all(b - a >= 3 for a, b in zip(snapped, snapped[1:]))
    assert any(x[1] for x in found["a"])
    with pytest.raises(Exception, match="boundaries nearer"):
        folds.snap_cuts(spark.createDataFrame([("a", 0), ("a", 2), ("a", 9)], "seq string, frame long"), marks, "seq", "frame", 4, 3).collect()
    assert folds.snap_cuts(cuts.limit(0), marks, "seq", "frame", 4, 3).count() == 0


@pytest.mark.parametrize("block", [1, 5, 4_096])
def test_places_apart(spark, block):
    rng = random.Random(1)
    places = {name: sorted(rng.sample(range(400), 90)) for name in ("a", "b", None)} | {"one": [7]}
    df = spark.createDataFrame([(s, f) for s, fs in places.items() for f in fs], "seq string, frame long")
    found = {}
    for r in folds.apart(df, "seq", "frame", 9, block).collect():
        found.setdefault(r["seq"], []).append(r["frame"])
    for name, fs in places.items():
        want = []
        for f in fs:
            if not want or f - want[-1] >= 9:
                want.append(f)
        assert sorted(found[name]) == want
    assert folds.apart(df.limit(0), "seq", "frame", 9).count() == 0


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in ("a", None) for i in range(10)], "g string, frame long, e double")
    assert candidates.above_floor(df, "g", "e", 0.5).filter("g is null").count() == 5
    starts = candidates.phrase_starts(df.withColumn("new", df.e % 4), "g", "frame", "new", 0.5, 3)
    assert sorted(map(tuple, starts.filter("g is null").collect())) == [(None, 0), (None, 3), (None, 6)]


POOL = "seq string, nth long, pool array<struct<id: string, head: array<double>, head_velocity: array<double>, tail: array<double>, tail_velocity: array<double>>>"


@pytest.mark.parametrize("block", [1, 4, 4_096])
def test_seams_are_chosen_one_after_another(spark, block):
    rng = random.Random(3)
    pose = lambda: [rng.randrange(5) / 2, rng.randrange(5) / 2]
    slots = {s: [[(f"{i}.{k}", pose(), pose(), pose(), pose()) for k in range(rng.randrange(0, 5))] or rng.choice([None, []]) for i in range(30)] for s in ("a", None)}
    df = spark.createDataFrame([(s, i, p) for s, ps in slots.items() for i, p in enumerate(ps)], POOL)
    found = {(r["seq"], r["nth"]): (r["chosen"], r["cost"]) for r in folds.seam_path(df, "seq", "nth", "pool", 6, block).collect()}
    for name, pools in slots.items():
        last = None
        for i, pool in enumerate(pools):
            if not pool:
                last = None
                assert found[name, i] == (None, None)
                continue
            if last is None:
                last = pool[0]
                assert found[name, i] == (last[0], None)
                continue
            cost = lambda c: round(math.dist([t + v for t, v in zip(last[3], last[4], strict=True)], c[1]) + math.dist(last[4], c[2]), 9)  # noqa: B023, E731
            costs = [cost(c) for c in pool]
            assert abs(found[name, i][1] - min(costs)) < 1e-8
            last = pool[costs.index(min(costs))]
            assert found[name, i][0] == last[0]
    with pytest.raises(Exception, match="a pool of more than 2"):
        folds.seam_path(df, "seq", "nth", "pool", 2).collect()


def test_the_true_continuation_is_found(spark):
    """One candidate goes on with pose and velocity; one is far away, one goes back."""
    tail = ("t", [0.0], [0.0], [1.0], [0.1])
    pool = [("far", [5.0], [0.1], [0.0], [0.0]), ("back", [1.1], [-0.4], [0.0], [0.0]), ("good", [1.1], [0.1], [0.0], [0.0])]
    got = folds.seam_path(spark.createDataFrame([("s", 0, [tail]), ("s", 1, pool)], POOL), "seq", "nth", "pool")
    assert {r["nth"]: r["chosen"] for r in got.collect()} == {0: "t", 1: "good"}
