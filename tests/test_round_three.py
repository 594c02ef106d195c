"""Planted cases of the third round's findings."""

import datetime

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.operators import candidates, clusters, folds, nulls, quantiles, recurrence, retrieval, selfsimilarity, timeline
from larkspur.plans import catalogue


def _events(spark, folder, rows):
    """A table of events of user 1: (event_type, value) in order."""
    at = datetime.datetime(2024, 1, 1)
    told = [(i, at + datetime.timedelta(seconds=i), 1, kind, float(value)) for i, (kind, value) in enumerate(rows)]
    spark.createDataFrame(told, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _by_sql(name, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(db.execute(catalogue.oracle_sql()[name]).fetchall())


def test_means_that_differ_by_five_are_a_boundary_whatever_the_order_of_the_sums(spark, tmp_path):
    # In floating point 8.2 - 3.2 is less than 5: it is a boundary all the same.
    folder = _events(spark, tmp_path, [("view", 3.2)] * 3 + [("click", 8.2), ("view", 8.2)])
    got = sorted(tuple(r) for r in catalogue.queries()["boundaries_dropped"](spark, folder).select("user_id", "start", "end", "runs").collect())
    assert got == [(1, 0, 3, 1), (1, 3, 5, 2)] == _by_sql("boundaries_dropped", folder)


def test_a_quantile_of_equal_values_is_their_value(spark):
    df = spark.createDataFrame([(1, 1.39)] * 5, "g int, v double")
    assert {r["g"]: r["cut"] for r in quantiles.linear(df, "g", "v", {"cut": 0.3}).collect()} == {1: 1.39}


def test_deep_events_keeps_clicks_that_equal_their_quantile(spark, tmp_path):
    folder = _events(spark, tmp_path, [("click", 1.39)] * 5)
    got = sorted(tuple(r) for r in catalogue.queries()["deep_events"](spark, folder).select("user_id", "event_id", "value").collect())
    assert got == [(1, i, 1.39) for i in range(5)] == _by_sql("deep_events", folder)


def test_phrase_starts_takes_no_step_that_equals_its_quantile(spark):
    # Steps of one size: none is above the quantile, whatever the last bits of the interpolation.
    part = 0.7 * 11 - 7
    x = [v for v in (i / 100 for i in range(100, 2000)) if v * (1 - part) + v * part < v][0]
    rows = spark.createDataFrame([(1, i, x) for i in range(12)], "user_id long, frame long, novelty double")
    assert [r["frame"] for r in candidates.phrase_starts(rows, "user_id", "frame", "novelty", 0.7, 3).collect()] == [0]


def test_phrase_starts_takes_its_quantile_at_an_exact_place(spark, tmp_path):
    # 0.7 * 90 is less than 63 in floating point. The quantile of 63 steps below 28, one of 28 and 27 of 29 is 28, which is not above itself.
    steps = [0] + [1] * 62 + [28] + [29] * 27
    values = [sum(s if i % 2 else -s for i, s in enumerate(steps[: n + 1])) for n in range(91)]
    folder = _events(spark, tmp_path, [("view", v) for v in values])
    got = sorted(tuple(r) for r in catalogue.queries()["phrase_starts"](spark, folder).select("user_id", "frame").collect())
    assert got == [(1, 0), (1, 64), (1, 72), (1, 80), (1, 88)] == _by_sql("phrase_starts", folder)


def test_phrase_starts_leaves_out_steps_without_a_value(spark, tmp_path):
    # Two steps are known, 0 and 5; as zeros the unknown ones would count towards the quantile.
    at = datetime.datetime(2024, 1, 1)
    values = [1.0, 6.0, None, None, None, 1.0, None, None, 2.0, 4.0]
    told = [(i, at + datetime.timedelta(seconds=i), 1, "view", v) for i, v in enumerate(values)]
    spark.createDataFrame(told, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["phrase_starts"](spark, str(tmp_path)).select("user_id", "frame").collect())
    assert got == [(1, 0)] == _by_sql("phrase_starts", str(tmp_path))


def test_seam_ratio_rounds_the_exact_fraction(spark, tmp_path):
    # 0.8 over 2 frames against 16000: 2.5 hundred-thousandths, which floats put below.
    folder = _events(spark, tmp_path, [("view", 16000)] * 3 + [("view", 0.1), ("click", 0.7)])
    got = [tuple(r) for r in catalogue.queries()["seam_ratio"](spark, folder).collect()]
    assert got == [(1, 0.00003)] == _by_sql("seam_ratio", folder)


def test_tiles_meet_all_pairs_and_ties_go_to_the_least_id(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", (3, 4))
    rows = spark.createDataFrame([(i, [float(i % 7), 0.0], i % 2) for i in range(40)], "id long, x array<double>, label int")
    got = {(r["query_id"], r["rank"]): (r["row_id"], r["distance"]) for r in retrieval.nearest(rows.filter("id % 4 = 0"), rows, "id", "x", "label", 3).collect()}
    for q in range(0, 40, 4):
        want = sorted((float((q % 7 - i % 7) ** 2), i) for i in range(40) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, d) for d, i in want]
    # A few queries a pass, and counts digit by digit, give the same.
    monkeypatch.setattr(retrieval, "DIGIT", 5)
    far = sorted(float((q % 7 - i % 7) ** 2) for q in range(0, 40, 4) for i in range(1, 40, 2))
    place = 0.95 * (len(far) - 1)
    down = far[::-1]
    cut = retrieval.ranked_distances(rows.filter("id % 4 = 0"), rows, "id", "x", "label", 0.95)
    assert min(down[int(place)], down[int(place) + 1]) <= cut <= max(down[int(place)], down[int(place) + 1])


def test_short_sequences_are_not_cut_into_blocks(spark, monkeypatch):
    # The totals that are joined are one for each sequence and draw, not one for each row.
    seen = []
    running = timeline.running
    monkeypatch.setattr(timeline, "running", lambda placed, sequence, block, *a, **k: (seen.append(placed.select("key_", "block_").distinct().count()) if "block_" in placed.columns else None) or running(placed, sequence, block, *a, **k))
    got = nulls.random_points(spark.createDataFrame([(1, 60, 5), (2, 40, 50)], "s int, n int, k int"), "s", "n", "k", 2)
    assert seen == [4] and got.count() == 2 * (5 + 38)


def test_nearest_in_class_meets_neighbouring_values_only(spark):
    rows = [(1, "a", 5.0), (2, "a", 5.0), (3, "a", 5.0), (4, "a", 7.0), (5, "a", 9.0), (6, "b", 1.0), (7, "a", None), (8, "c", None), (9, "c", 2.0)]
    df = spark.createDataFrame(rows, "id long, c string, x double")
    got = {r["id"]: r["donor"] for r in candidates.nearest_in_class(df, df, "c", "id", "x").collect()}
    # Equal values first, then the lesser key of two as far; without a value the least other key.
    assert got == {1: 2, 2: 1, 3: 1, 4: 1, 5: 4, 7: 1, 8: 9, 9: 8}


def test_equal_short_segments_are_merged_in_few_rounds(spark, monkeypatch):
    # Each waits for the one before it: blocks of ten settle them as one block does.
    at, to = selfsimilarity._merged(list(range(60)), list(range(1, 61)), 4, True, True)
    assert min(b - a for a, b in zip(at, to, strict=True)) >= 4 and at[1:] == to[:-1]
    monkeypatch.setattr(selfsimilarity, "MERGED", 20)
    starts = spark.createDataFrame([(1, i) for i in range(60)], "s int, start int")
    got = selfsimilarity.merge_short(starts, "s", "start", spark.createDataFrame([(1, 60)], "s int, n int"), "n", 4).collect()
    assert sorted((r["start"], r["end"]) for r in got) == list(zip(at, to, strict=True))


def test_sequences_of_one_block_are_run_once_and_side_by_side(spark, monkeypatch):
    # No tables of states are made for them, and a task calls the rule once for many of them.
    seen = []
    staged = folds.staged
    monkeypatch.setattr(folds, "staged", lambda df, name: seen.append(name) or staged(df, name))
    rows = spark.createDataFrame([(s, f) for s in range(300) for f in (0, 4, 9, 20)], "s int, frame long")
    got = sorted(tuple(r) for r in folds.apart(rows, "s", "frame", 9).collect())
    assert got == [(s, f) for s in range(300) for f in (0, 9, 20)] and seen == ["fold"]
    batches = pa.table({"nth_": [n for k in range(300) for n in range(k % 5 + 1)]}).to_batches(7)
    found = [(t.num_rows, len(at)) for t, at in folds._blocks(iter(batches), 5, 100)]
    assert sum(n for n, _ in found) == 900 and sum(k for _, k in found) == 300 and len(found) < 20


def test_recurrence_of_short_sequences_needs_no_pairs_of_blocks(spark, monkeypatch):
    seen = []
    met = recurrence.met
    monkeypatch.setattr(recurrence, "met", lambda blocks, *a, **k: seen.append({r["key_"]["s"] for r in blocks.select("key_").distinct().collect()}) or met(blocks, *a, **k))
    value = lambda s, i: float(i * i % (11 + s))
    told = lambda lengths: spark.createDataFrame([(s, i, [value(s, i)], i % 3 == 0) for s, n in lengths for i in range(n)], "s int, f long, x array<double>, e boolean")
    run = lambda lengths, block: {(r["s"], r["frame"]): r["recurrence"] for r in recurrence.event_recurrence(told(lengths), "s", "f", "x", F.col("e"), 2, 0.1, block).collect()}
    lengths = [(0, 1), (1, 5), (2, 8), (3, 20)]
    got = run(lengths, 32)
    assert not seen and len(got) == 1 + 2 + 3 + 7
    # One sequence of three blocks beside short ones: the same, and it alone is paired.
    assert run(lengths, 8) == got and seen and all(s == {3} for s in seen)


def test_rounds_of_kmeans_read_what_was_written_once(spark, monkeypatch):
    # The source is read for the table of vectors and no more; a round is one pass of sums.
    monkeypatch.setattr(clusters, "nearest", lambda *a: 1 / 0)
    monkeypatch.setattr(clusters, "TILE", 6)
    rows = spark.createDataFrame([(i, [float(i % 10 + 100 * (i % 2)), 1.0]) for i in range(40)] + [(40, None)], "id long, v array<double>")
    got = {r["label"]: r["center"] for r in clusters.kmeans(rows, "id", "v", 2, 100, start=[[0.0, 0.0], [50.0, 0.0]]).collect()}
    assert got == {0: [4.0, 1.0], 1: [105.0, 1.0]}
