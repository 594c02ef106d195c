"""Planted cases: ties, refusals, controls, order independence."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import contracts, graph, placement, ranks, retrieval, segments, splits, stats, timeline
from larkspur.sources import manifests
from larkspur.streaming import events as streaming


def test_majority_tie_goes_to_the_lower_label(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a")], "k int, v string")
    assert {r["k"]: r["v"] for r in ranks.majority(df, ["k"], "v").collect()} == {1: "a", 2: "b"}


def test_centered_vote_keeps_the_center_on_a_tie(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate("xyyx")], "s string, f long, v string")
    got = {r["f"]: r["voted"] for r in timeline.centered_vote(df, "s", "f", "v", 1).collect()}
    assert got == {0: "x", 1: "y", 2: "y", 3: "x"}


def test_runs_break_at_gaps_and_keep_null_runs(spark):
    df = spark.createDataFrame([("s", 0, 1), ("s", 1, 1), ("s", 3, 1), ("s", 4, None), ("s", 5, None)], "s string, f int, v int")
    got = [(r["v"], r["start"], r["end"]) for r in timeline.runs(df, "s", "f", "v").orderBy("start").collect()]
    assert got == [(1, 0, 2), (1, 3, 4), (None, 4, 6)]


def test_windows_of_short_sequences_are_none(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5)], "s string, n long")
    got = [(r["s"], r["start"], r["end"]) for r in timeline.windows(df, "s", "n", 4, 1).orderBy("start").collect()]
    assert got == [("b", 0, 4), ("b", 1, 5)]


def test_centered_vote_counts_nulls_and_gaps(spark):
    df = spark.createDataFrame([("s", 0, "x"), ("s", 1, None), ("s", 2, None), ("s", 7, "y")], "s string, f long, v string")
    got = {r["f"]: r["voted"] for r in timeline.centered_vote(df, "s", "f", "v", 1).collect()}
    assert got == {0: "x", 1: None, 2: None, 7: "y"}


@pytest.mark.parametrize(
    ("runs", "want"),
    [
        ([("a", 0, 5), ("b", 5, 6), ("c", 6, 9)], [("a", 0, 5), ("c", 5, 9)]),  # into the shorter neighbour
        ([("a", 0, 4), ("b", 4, 5), ("c", 5, 9)], [("a", 0, 5), ("c", 5, 9)]),  # the left of equals
        ([("a", 0, 4), ("b", 4, 5), ("a", 5, 8)], [("a", 0, 8)]),  # equal neighbours join
        ([("a", 0, 1), ("b", 1, 2)], [("b", 0, 2)]),  # until one is left
        ([("a", 0, 1)], [("a", 0, 1)]),
    ],
)
def test_short_runs_merge_shortest_first(spark, runs, want):
    df = spark.createDataFrame([("s", *r) for r in runs], "s string, v string, start long, end long")
    assert [tuple(r)[1:] for r in segments.merged_short(df, "s", "v", 3).orderBy("start").collect()] == want


def test_minima_keep_their_distance(spark):
    values = [5.0, 1.0, 5.0, 2.0, 5.0, 5.0, 5.0, 0.5, 5.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, f long, v double")
    lows = segments.minima(df, "s", "f", "v", 0.98)
    assert {r["f"] for r in lows.collect()} == {1, 3, 7}
    assert {r["f"] for r in segments.apart(lows, "s", "f", "v", 4, 4).collect()} == {1, 7}
    assert {(r["f"], r["v"]) for r in segments.merged_points(lows, "s", "f", "v", 3).collect()} == {(1, 1.0), (7, 0.5)}


def test_snapped_windows_and_stitching(spark):
    lengths = spark.createDataFrame([("a", 10), ("b", 3), ("c", 8)], "s string, n long")
    got = sorted((r["s"], r["start"]) for r in segments.snapped_windows(lengths, "s", "n", 4, 4).collect())
    assert got == [("a", 0), ("a", 4), ("a", 6), ("c", 0), ("c", 4)]
    written = spark.createDataFrame([("s", 0, 0, "x"), ("s", 1, 0, "x"), ("s", 1, 1, "y")], "s string, f long, start long, v string")
    assert {(r["f"], r["v"], r["writers"], r["conflict"]) for r in segments.stitched(written, "s", "f", "start", "v").collect()} == {(0, "x", 1, False), (1, "x", 2, True)}


def test_padded_mean_at_the_edges(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 4, 7])] + [("t", 0, 2.0)], "s string, f long, v double")
    got = {(r["s"], r["f"]): r["smooth"] for r in segments.padded_mean(df, "s", "f", "v", 2).collect()}
    assert got == {("s", 0): (1 + 1 + 1 + 4 + 7) / 5, ("s", 1): (1 + 1 + 4 + 7 + 7) / 5, ("s", 2): (1 + 4 + 7 + 7 + 7) / 5, ("t", 0): 2.0}


def test_located_before_all_spans_is_null(spark):
    spans = spark.createDataFrame([("s", 3, 5), ("s", 5, 9)], "s string, start long, end long")
    points = spark.createDataFrame([("s", 2), ("s", 3), ("s", 5), ("s", 12)], "s string, t long")
    got = {r["t"]: (r["span_start"], r["span_end"]) for r in segments.located(points, spans, "s", "t", []).collect()}
    assert got == {2: (None, None), 3: (3, 5), 5: (5, 9), 12: (5, 9)}


@pytest.mark.parametrize(("wins", "losses", "want"), [(1, 1, 1.0), (5, 0, 0.0625), (8, 2, 0.109375), (0, 0, None)])
def test_exact_sign_test(spark, wins, losses, want):
    rows = [(2, 1)] * wins + [(1, 2)] * losses + [(1, 1)]
    got = stats.sign_test(spark.createDataFrame(rows, "x int, y int"), F.col("x"), F.col("y")).first()
    assert (got["wins"], got["losses"], got["ties"], got["p"]) == (wins, losses, 1, want)


def test_mean_ranks_and_row_numbers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, 1, 3, 2])], "i long, v long")
    assert {r["i"]: r["r"] for r in ranks.mean_ranks(df, "v", "r").collect()} == {0: 3.5, 1: 1.0, 2: 3.5, 3: 2.0}
    many = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    assert ranks.row_numbers(many, "g", "k", "n").filter("n <> k div 2").isEmpty()


def test_more_queries_take_more_passes(spark):
    q = spark.createDataFrame([(i, float(i)) for i in range(40)], "q long, x double")
    r = spark.createDataFrame([(i, float(i)) for i in range(7)], "r long, y double")
    assert retrieval.against(q, r, pass_size=16).select("q", "r").distinct().count() == 280


def test_placement(spark):
    df = spark.createDataFrame([("a", "train", None), ("a", "train", "train"), ("a", "val", None), ("b", "val", "val"), ("b", "train", "train"), ("c", "val", None)], "c string, split string, pin string")
    assert [tuple(r) for r in placement.straddling(df, "c", "split").orderBy("c").collect()] == [("a", 2, 1), ("b", 2, 1)]
    assert {r["c"]: r["placement"] for r in placement.pinned(df, "c", "pin").collect()} == {"a": "train", "b": "refused", "c": "free"}
    assert placement.chaining_guard(df, "c", 0.4).first()["void"]
    five = spark.range(5).select(F.lit("g").alias("g"), "id")
    assert [r["id"] for r in placement.evenly_spaced(five, "g", "id", 3).orderBy("id").collect()] == [0, 2, 4]


def test_nearest_event_before_after_and_none(spark):
    df = spark.createDataFrame([("a", 1, 10, "beat"), ("a", 2, 14, "move"), ("a", 3, 15, "beat"), ("b", 4, 1, "move")], "s string, id int, t long, k string")
    got = {r["id"]: (r["before"], r["after"], r["distance"]) for r in timeline.nearest_events(df, "s", F.col("t"), F.col("k") == "beat", F.col("k") == "move", "id").collect()}
    assert got == {2: (10, 15, 1), 4: (None, None, None)}


def test_split_does_not_depend_on_row_order(spark):
    ids = list(range(200))
    one = splits.rank_split(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
    two = splits.rank_split(spark.createDataFrame([(i,) for i in reversed(ids)], "id long").repartition(7), "id")
    assert sorted(one.collect()) == sorted(two.collect())
    assert {r["split"]: r["count"] for r in one.groupBy("split").count().collect()} == {"train": 160, "val": 20, "test": 20}


def test_group_across_splits_positive_and_negative(spark):
    df = spark.createDataFrame([("g", "train"), ("g", "val"), ("h", "val"), ("h", "val")], "g string, split string")
    assert [(r["value"], r["n_splits"]) for r in splits.spanning_groups(df, ["g"]).collect()] == [("g", 2)]


def test_components_chain_and_singleton(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(3, 2), (2, 1), (7, 8)], "u long, v long")
    vertices = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "id long")
    got = {r["id"]: r["component"] for r in graph.components(edges, vertices, "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}


def test_null_safe_disagreement(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "p", "x")], "k int, f string, g string")
    b = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "k int, f string, g string")
    assert [(r["k"], r["differing"]) for r in contracts.disagreements(a, b, ["k"], ["f", "g"]).collect()] == [(2, "f,g")]


def test_alias_conflict_is_refused(spark):
    ok = spark.createDataFrame([("a", None), ("b", "b")], "x string, y string")
    assert [r[0] for r in ok.select(contracts.agreed_alias(["x", "y"])).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="disagree"):
        spark.createDataFrame([("a", "b")], "x string, y string").select(contracts.agreed_alias(["x", "y"])).collect()


@pytest.mark.parametrize(("rule", "want"), [("ceil", 3), ("nearest", 3)])
def test_ranked_quantiles(spark, rule, want):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5)], "v long")
    assert ranks.ranked_quantile(df, "v", 0.5, rule).first()["quantile"] == want


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, True), (1, False)], "s long, y boolean")
    assert stats.rank_auc(df, "s", F.col("y")).first()["auc"] == 0.5


def test_manifest_latest_row_wins_and_corrupt_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps({"id": "a", "at": 1.0, "v": 1}), "{bad", json.dumps({"id": "a", "at": 2.0, "v": 2})]))
    schema = spark.createDataFrame([], "id string, at double, v int").schema
    good, bad = manifests.read_tolerant(spark, str(tmp_path), schema)
    assert [r["v"] for r in manifests.latest(good, "id", "at").collect()] == [2]
    assert [r["line"] for r in bad.collect()] == ["{bad"]
    manifests.write_canonical(good, str(tmp_path / "out"), "id")
    with pytest.raises(Exception, match="(?i)exists"):
        manifests.write_canonical(good, str(tmp_path / "out"), "id")


def test_streams_leave_rows_in_files_and_close_every_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "_folder", lambda spark: str(tmp_path / "shared"), raising=False)
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 05:00:00", 4.0), (None, "2024-01-01 05:10:00", 8.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "events.parquet"))
    got = streaming.drained_sessions(stream)
    assert sorted((str(r["user_id"]), r["events"], r["value"]) for r in got.collect()) == [("1", 1, 4.0), ("1", 2, 3.0), ("None", 1, 8.0)]
    assert (tmp_path / "shared" / "state" / "offsets").is_dir() and got.inputFiles()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("drained_")]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_blocks_of_a_sequence_change_nothing(spark, broadcast):
    """Every timeline operator gives the same rows with blocks of four frames or ranges of four rows as with one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        blocks_change_nothing(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def blocks_change_nothing(spark):
    df = spark.range(240).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("cold")).alias("s"), "id", (F.col("id") * 7 % 41).alias("t"), (F.hash("id") % 3).alias("v"), (F.col("id") * 13 % 17).cast("double").alias("x"))
    one, many = timeline.frames(df, "s", ["t", "id"], "f"), timeline.frames(df, "s", ["t", "id"], "f", rows=4)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert one.count() == 240 and same(one, many)
    for name, op, last in (
        ("runs", lambda b: timeline.runs(one, "s", "f", "v", b), None),
        ("vote", lambda b: timeline.centered_vote(one, "s", "f", "v", 2, b), None),
        ("mean", lambda b: segments.padded_mean(one, "s", "f", "x", 2, b), None),
        ("differences", lambda b: segments.differences(one, "s", "f", "x", 3, b), None),
        ("minima", lambda b: segments.minima(one, "s", "f", "x", 0.98, b), None),
        ("lags", lambda b: segments.lagged_correlation(one, "s", "f", "x", "x", 3, 2, b), "r"),
        ("nearest", lambda b: timeline.nearest_events(df, "s", F.col("t"), F.col("v") == 0, F.col("v") == 1, "id", b), None),
        ("sessions", lambda b: timeline.sessions(df, "s", F.col("t") * 3, 4.0, b), None),
        ("located", lambda b: segments.located(one.filter("v = 1"), one.filter("f % 5 = 2").select("s", F.col("f").alias("start"), (F.col("f") + 3).alias("end")), "s", "f", [], b), None),
    ):
        a, b = op(1_000_000), op(4)
        if last:
            a, b = (d.withColumn(last, F.round(last, 9)) for d in (a, b))
        assert a.count() > 0 and same(a, b), name
