"""Bars' tokens, labels by span, grids and shapes against plain rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import bars

ROW = "seq string, frame long, label string, beat boolean, x double, n double"


def frames_of(spark, plan):
    return spark.createDataFrame([(s, i, *r) for s, rs in plan.items() for i, r in enumerate(rs)], ROW)


@pytest.mark.parametrize("block", [3, 65_536])
def test_tokens_are_the_plain_pools(spark, block):
    rng = random.Random(block)
    plan = {s: [(rng.choice("abc"), rng.choice([True, False, None]), rng.choice([None, rng.random()]), float(rng.randrange(3))) for _ in range(60)] for s in ("p", "q", None)}
    spans = [(s, at, at + n) for s in plan for at, n in ((0, 1), (1, 7), (12, 8), (20, 30))]
    got = bars.tokens(frames_of(spark, plan), spark.createDataFrame(spans, "seq string, start long, end long"), "seq", "frame", "label", F.col("beat"), ["x"], ["n"], block)
    found = {(r["seq"], r["start"]): r for r in got.collect()}
    assert len(found) == len(spans)
    tally = {"wrong": 0, "mixed": 0, "off": 0, "other": 0}
    for s, a, b in spans:
        part, r = plan[s][a:b], found[s, a]
        labels = [p[0] for p in part]
        top = min(set(labels), key=lambda v: (-labels.count(v), v))
        beats = [i for i, p in enumerate(part) if p[1]]
        known = [p[2] for p in part if p[2] is not None]
        assert (r["end"], r["label"], r["wrong"], r["mixed"]) == (b, top, len(part) - labels.count(top), len(set(labels)) > 1)
        assert (r["beats"], r["on_beat"]) == (len(beats), beats[:1] == [0])
        assert r["x_mean"] is None if not known else abs(r["x_mean"] - sum(known) / len(known)) < 1e-12
        assert r["n_sum"] == sum(p[3] for p in part)
        tally["wrong"] += r["wrong"]
        tally["mixed"] += r["mixed"]
        tally["off"] += not r["on_beat"]
        tally["other"] += r["beats"] != 2
    told = bars.checks(got, 2).first()
    assert tuple(told) == (12, 3 * 46, tally["wrong"], tally["mixed"], tally["off"], tally["other"])


@pytest.mark.parametrize("span", [(0, 11), (9, 9), (-1, 2), (20, 24), (3, 7)])
def test_a_part_of_a_bar_is_an_error(spark, span):
    f = frames_of(spark, {"p": [("a" if i != 5 else None, True, 1.0, 1.0) for i in range(10)]})
    with pytest.raises(Exception, match="a bar without all of its frames"):
        bars.tokens(f, spark.createDataFrame([("p", *span)], "seq string, start long, end long"), "seq", "frame", "label", F.col("beat"), ["x"], ["n"]).collect()


def test_empty_tokens_and_checks(spark):
    f = frames_of(spark, {"p": [("a", True, 1.0, 1.0)]})
    none = bars.tokens(f, spark.createDataFrame([], "seq string, start long, end long"), "seq", "frame", "label", F.col("beat"), ["x"], ["n"])
    assert none.count() == 0 and tuple(bars.checks(none, 4).first()) == (0,) * 6


def test_the_last_window_names_a_span_and_conflicts_are_told(spark):
    rows = [("s", 0, 4, 1, 10), ("s", 0, 4, 1, 11), ("s", 4, 8, 1, 10), ("s", 4, 8, 2, 11), (None, 0, 4, 3, 1), (None, 0, 4, None, 2), ("t", 0, 4, 7, 5), ("t", 0, 4, 6, 5)]
    w = spark.createDataFrame(rows, "seq string, start long, end long, label long, w long")
    got = {(r["seq"], r["start"]): (r["label"], r["writers"], r["conflict"]) for r in bars.span_labels(w, "seq", "label", "w").collect()}
    assert got == {("s", 0): (1, 2, False), ("s", 4): (2, 2, True), (None, 0): (None, 2, True), ("t", 0): (6, 2, True)}
    with pytest.raises(Exception, match="windows disagree"):
        bars.span_labels(w, "seq", "label", "w", refuse=True).collect()
    assert bars.span_labels(w.filter("start = 0 and seq = 's'"), "seq", "label", "w", refuse=True).first()["conflict"] is False


def test_released_spans_are_a_prefix_of_the_grid(spark):
    grid = [(s, n, 4 * n, 4 * n + 4) for s in ("a", "b", "c", None) for n in range(5)]
    mine = [g for g in grid if g[1] < 3 and g[0] != "b"] + [("b", 0, 0, 4), ("b", 1, 5, 8), ("c", 9, 36, 40)]
    of = lambda rows: spark.createDataFrame(rows, "seq string, nth long, start long, end long")
    got = {r["seq"]: (r["released"], r["equal"], r["prefix"]) for r in bars.same_grid(of(mine), of(grid), "seq", F.col("nth")).collect()}
    assert got == {"a": (3, 3, True), "b": (2, 1, False), "c": (4, 3, False), None: (3, 3, True)}


def test_shapes_are_the_cosine_transform(spark):
    rng = np.random.default_rng(2)
    x = {s: rng.normal(size=(50, 2)) for s in ("a", None)}
    df = spark.createDataFrame([(s, i, float(p), float(q)) for s, xs in x.items() for i, (p, q) in enumerate(xs)], "seq string, frame long, x double, y double")
    spans = [("a", 0, 1), ("a", 3, 5), ("a", 10, 43), (None, 0, 50), ("a", 45, 60), ("a", 7, 7)]
    got = {(r["seq"], r["start"], r["end"]): r["shape"] for r in bars.cosines(df, spark.createDataFrame(spans + spans[:1], "seq string, start long, end long"), "seq", "frame", ["x", "y"], 6, 4).collect()}
    assert len(got) == 6 and got["a", 45, 60] is None and got["a", 7, 7] is None
    basis = np.array([[math.sqrt((2 if k else 1) / 6) * math.cos(math.pi * k * (r + 0.5) / 6) for r in range(6)] for k in range(4)])
    assert np.allclose(basis @ basis.T, np.eye(4))
    for s, a, b in spans[:4]:
        part = x[s][a:b]
        at = np.linspace(0, len(part) - 1, 6)
        sampled = np.stack([np.interp(at, range(len(part)), part[:, c]) for c in (0, 1)], 1)
        assert np.allclose(got[s, a, b], [*(basis @ sampled).reshape(-1), math.log(b - a)])
    with pytest.raises(ValueError, match="terms"):
        bars.cosines(df, df, "seq", "frame", ["x"], 4, 5)
