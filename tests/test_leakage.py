"""Measured leakage against a plain version, with planted copies and a hub."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import leakage

LAGS = [-4, -2, 0, 2, 4]


def plain_distance(a, b, lag, least=8):
    gaps = [np.linalg.norm(a[t] - b[t - lag]) for t in range(len(a)) if 0 <= t - lag < len(b)]
    return round(float(np.median(gaps)), 9) if len(gaps) >= least else None


def plain_reading(held, pool, back, scan, fewest=20, top=5):
    turn = lambda x: x[::-1] if back else x
    d = {h: {p: v for p, y in pool.items() if (v := plain_distance(x, turn(y), 0)) is not None} for h, x in held.items()}
    out = {}
    for h, row in d.items():
        if len(row) < fewest:
            continue
        near = sorted(row, key=lambda p: (row[p], p))[: top if scan else 1]
        found = []
        for p in near:
            lagged = [(v, i) for i, lag in enumerate(LAGS if scan else [0]) if (v := plain_distance(held[h], turn(pool[p]), lag)) is not None]
            v, i = min(lagged)
            found.append((v, p, (LAGS if scan else [0])[i]))
        v, p, lag = min(found)
        column = [r[p] for r in d.values() if p in r]
        own, other = np.quantile(list(row.values()), 0.05), np.quantile(column, 0.05) if len(column) >= fewest else 0
        out[h] = (p, v, lag, max([v / q for q in (own, other) if q > 0]))
    return out


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(7)
    make = lambda n: np.cumsum(rng.normal(size=(n, 2)), axis=0)
    pool = {1000 + i: make(int(rng.integers(20, 40))) for i in range(70)}
    held = {i: make(int(rng.integers(20, 40))) for i in range(66)}
    for i in range(6):
        held[i] = pool[1000 + i] + rng.normal(scale=0.01, size=pool[1000 + i].shape)
    held[6] = pool[1010][2:]  # a copy that begins two frames later
    pool[1069] = np.zeros((40, 2))  # near to everything
    held[7] = make(5)  # too short for any reading
    return held, pool


def frame_of(spark, rows):
    return spark.createDataFrame([(k, [[float(v) for v in f] for f in x]) for k, x in rows.items()], "id long, x array<array<double>>")


@pytest.fixture(scope="module")
def readings(spark, sequences):
    held, pool = sequences
    got = leakage.measured(frame_of(spark, held), frame_of(spark, pool), "id", "x", LAGS, (100, 100))
    return spark.createDataFrame(got.collect(), got.schema)


def test_readings_are_the_plain_ones(readings, sequences):
    held, pool = sequences
    ahead, null, matched = (plain_reading(held, pool, back, scan) for back, scan in ((False, True), (True, False), (True, True)))
    got = {r["id"]: r for r in readings.collect()}
    assert set(got) == set(ahead) and 7 not in got and len(got) == 65
    for h, (p, v, lag, ratio) in ahead.items():
        r = got[h]
        assert (r["nearest"], r["distance"], r["lag"]) == (p, v, lag)
        assert np.allclose([r["ratio"], r["null_ratio"], r["matched_ratio"]], [ratio, null[h][3], matched[h][3]])


def test_planted_copies_are_flagged_and_a_hub_is_not(readings):
    got = {r["id"]: r for r in readings.collect()}
    assert all(got[i]["nearest"] == 1000 + i and got[i]["ratio"] < 0.1 for i in range(6))
    assert got[6]["nearest"] == 1010 and got[6]["lag"] == -2 and got[6]["distance"] == 0
    assert all(r["ratio"] > 0.2 for i, r in got.items() if i > 7)
    told = leakage.report(readings, F.col("id") < 7, F.col("id") < 7).first()
    assert told["checked"] == 65 and told["positives"] == 7 and told["negatives"] == 58
    assert told["controls_separate"] and told["flagged"] >= 7 and told["excess"] > 0
    ratios = sorted(r["ratio"] for i, r in got.items() if i > 7)
    assert told["threshold"] == ratios[round(0.05 * 57)]
    assert abs(told["positive_median"] - np.median([got[i]["ratio"] for i in range(7)])) < 1e-12


def test_drawn_sizes_and_too_few(spark, sequences):
    held, pool = sequences
    few = leakage.measured(frame_of(spark, held), frame_of(spark, pool), "id", "x", LAGS, (10, 25))
    assert 0 < few.count() <= 10
    assert leakage.measured(frame_of(spark, held), frame_of(spark, pool), "id", "x", LAGS, (10, 15)).count() == 0
    empty = leakage.measured(frame_of(spark, {}), frame_of(spark, pool), "id", "x", LAGS, (10, 25))
    told = leakage.report(empty, F.lit(True), F.lit(True)).first()
    assert told["checked"] == 0 and told["threshold"] is None and told["flagged"] == 0 and not told["controls_separate"]
    assert leakage.drawn(frame_of(spark, pool), "id", 5).count() == 5
