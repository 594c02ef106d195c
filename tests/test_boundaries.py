"""Sudden rows, contrast across cuts and disagreement of plans against plain rules."""

import hashlib
import random

import numpy as np
import pytest

from larkspur.operators import boundaries


def test_sudden_rows_need_both_the_floor_and_the_ratio(spark):
    scores = {"slow": [1.0, 1.0, 2.0, 9.0, 31.0], "fast": [20.0, 25.0, 30.0, 90.0, None], "still": [0.0, 0.0, 0.0, 8.0, 12.0], None: [1.0, 40.0, 1.0], "none": [None]}
    df = spark.createDataFrame([(s, i, x) for s, xs in scores.items() for i, x in enumerate(xs)], "seq string, frame long, x double")
    got = {(r["seq"], r["frame"]) for r in boundaries.sudden(df, "seq", "x", 10.0, 3.0).collect()}
    assert got == {("slow", 4), ("fast", 3), ("still", 4), (None, 1)}


def plain_contrast(x, cuts, window):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)

    def across(p):
        a, b = u[p - window : p].mean(0), u[p : p + window].mean(0)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12)

    inner = sorted({c for c in cuts if window <= c <= len(x) - window})
    pool = [p for p in range(window, len(x) - window) if all(abs(p - c) > window for c in inner)]
    drawn = sorted(pool, key=lambda p: hashlib.sha256(f"42:{p}".encode()).hexdigest())[: len(inner)]
    if not inner or not drawn:
        return len(inner), len(drawn), None
    return len(inner), len(drawn), np.mean([across(p) for p in drawn]) - np.mean([across(c) for c in inner])


@pytest.mark.parametrize("window", [1, 3])
def test_contrast_is_the_plain_rule_and_true_cuts_have_more(spark, window):
    rng = np.random.default_rng(window)
    changes = [14, 27, 41, 60]
    steady = np.concatenate([np.tile(rng.normal(size=4), (n, 1)) for n in np.diff([0, *changes, 80])]) + rng.normal(scale=0.02, size=(80, 4))
    plan = {"true": (steady, [*changes, 27, 0, 80]), "wrong": (steady, [7, 20, 34, 50]), None: (rng.normal(size=(30, 4)), [9, 10, 22]), "crowded": (rng.normal(size=(8, 4)), [2, 4, 6]), "no cuts": (rng.normal(size=(9, 4)), []), "short": (rng.normal(size=(1, 4)), [0])}
    frames = spark.createDataFrame([(s, i, [float(v) for v in row]) for s, (x, _) in plan.items() for i, row in enumerate(x)], "seq string, frame long, x array<double>")
    cuts = spark.createDataFrame([(s, c) for s, (_, cs) in plan.items() for c in cs], "seq string, frame long")
    got = {r["seq"]: (r["cuts"], r["drawn"], r["contrast"]) for r in boundaries.contrast(frames, cuts, "seq", "frame", "x", window).collect()}
    assert set(got) == set(plan)
    for s, (x, cs) in plan.items():
        n, k, c = plain_contrast(x, cs, window)
        assert got[s][:2] == (n, k), s
        assert got[s][2] is None if c is None else abs(got[s][2] - c) < 1e-9, s
    assert got["true"][2] > 0.1 > got["wrong"][2]


def test_disagreement_is_over_shared_frames_and_clips(spark):
    rng = random.Random(1)
    plans = {(seed, clip): [rng.choice("ab") for _ in range(rng.randrange(3, 9))] for seed in (1, 2, 3) for clip in ("x", "y", None) if (seed, clip) != (3, "y")}
    plans[4, "alone"] = ["a"]
    rows = [(s, c, i, v) for (s, c), vs in plans.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, (None, "x", 0, "a")], "seed long, clip string, frame long, label string")
    want = {}
    for a in (1, 2, 3):
        for b in range(a + 1, 4):
            parts = [np.mean([p != q for p, q in zip(plans[a, c], plans[b, c])]) for c in ("x", "y", None) if (a, c) in plans and (b, c) in plans]  # noqa: B905
            want[a, b] = (len(parts), np.mean(parts), min(parts), max(parts))
    got = {(r["seed"], r["other"]): tuple(r)[2:] for r in boundaries.disagreement(df, "seed", "clip", "frame", "label").collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    null = spark.createDataFrame([(1, "x", 0, None), (2, "x", 0, None), (1, "x", 1, None), (2, "x", 1, "a")], "seed long, clip string, frame long, label string")
    assert boundaries.disagreement(null, "seed", "clip", "frame", "label").first()["mean"] == 0.5
