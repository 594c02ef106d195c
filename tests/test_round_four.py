"""Planted cases of the fourth round's findings."""

import duckdb
import pytest

from larkspur.operators import strips
from larkspur.plans import catalogue


def _vectors(spark, folder, rows):
    """A table of embeddings: (vec_id, first two components, label)."""
    told = [(i, [float(x), float(y)] + [0.0] * 62, label) for i, x, y, label in rows]
    spark.createDataFrame(told, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def _both(spark, name, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    sql = db.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, folder).select(*sql.columns).collect()
    return sorted(map(tuple, got)), sorted(sql.fetchall())


def test_neighbour_class_share_asks_rows_of_any_id(spark, tmp_path):
    # No id is divisible by 100; the label 1 sits apart from the label 2.
    folder = _vectors(spark, tmp_path, [(i, i % 2 * 50 + i, 0, i % 2 + 1) for i in range(1, 21)])
    got, want = _both(spark, "neighbour_class_share", folder)
    assert got == want == [(20, 1.0, 0.5)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_strips_find_what_brute_force_finds(spark, monkeypatch, kind):
    monkeypatch.setattr(strips, "LEAST", 20)
    monkeypatch.setattr(strips, "PACK", 7)
    monkeypatch.setattr(strips, "TILE", 11)
    # A large group of equal vectors, ties, and far ones whose single-precision products are beyond the largest number.
    at = {i: (0.0 if i % 3 else float(i % 7)) * (1e25 if i % 50 == 9 else 1) for i in range(101, 301)}
    rows = spark.createDataFrame([(i, [x, 1.0], i % 4) for i, x in at.items()], f"id long, x array<{kind}>, label int")
    got = {(r["query_id"], r["rank"]): (r["row_id"], r["distance"]) for r in strips.nearest(rows, "id", "x", "label", 3).collect()}
    at = {r["id"]: float(r["x"][0]) for r in rows.collect()}
    for q in at:
        want = sorted(((at[q] - x) ** 2, i) for i, x in at.items() if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, round(d, 6)) for d, i in want]


def test_strips_keep_rows_that_are_equal_in_id_or_no_number(spark):
    # Equal ids are one query and never its own neighbour; no number is the farthest; null vectors take no part.
    nan = float("nan")
    rows = spark.createDataFrame([(1, [0.0], 1), (1, [9.0], 1), (2, [1.0], None), (3, [nan], 1), (4, None, 1)], "id long, x array<double>, label int")
    got = [(r["query_id"], r["row_id"], str(r["distance"])) for r in strips.nearest(rows, "id", "x", "label", 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, "1.0"), (1, 2, "64.0"), (2, 1, "1.0"), (2, 1, "64.0"), (3, 1, "nan"), (3, 1, "nan")]


def test_operating_point_asks_rows_of_any_id(spark, tmp_path):
    folder = _vectors(spark, tmp_path, [(i, i * i % 17 / 4, i % 5, i % 3 if i % 8 else None) for i in range(1, 61)])
    got, want = _both(spark, "operating_point", folder)
    assert got == want and got[0][0] is not None


@pytest.mark.parametrize("scale", [1.0, 300.0, 5e4])
def test_operating_point_counts_two_blocks_once_for_both(spark, tmp_path, monkeypatch, scale):
    # Blocks in even number, tiles that are not full, digits of few bits, and vectors so long that every product is in doubt.
    monkeypatch.setattr(strips, "LEAST", 15)
    monkeypatch.setattr(strips, "PACK", 4)
    monkeypatch.setattr(strips, "HALF_TILE", 6)
    monkeypatch.setattr(strips.retrieval, "DIGIT", 9)
    folder = _vectors(spark, tmp_path, [(i, scale * (i * 37 % 101 / 100), scale * (i * i % 89 / 89), i % 4) for i in range(201, 291)])
    packs, n = strips.packed(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", "label")
    assert n == 6 and packs.count() > 12
    got, want = _both(spark, "operating_point", folder)
    assert got == want and 0 < got[0][2] < 0.1


def test_operating_point_of_one_label_is_none(spark, tmp_path):
    got, want = _both(spark, "operating_point", _vectors(spark, tmp_path, [(i, i, 0, 1) for i in range(1, 4)]))
    assert got == want == [(None, None, None)]


def test_r_precision_asks_rows_of_any_id(spark, tmp_path):
    folder = _vectors(spark, tmp_path, [(i, i % 4 * 50 + i, 0, i % 4 if i % 9 else None) for i in range(1, 41)])
    got, want = _both(spark, "r_precision", folder)
    assert got == want and [r[0] for r in got] == list(range(1, 41))


def test_topk_neighbours_asks_rows_of_any_id(spark, tmp_path):
    # Ties go to the least id.
    folder = _vectors(spark, tmp_path, [(i, i % 6, i % 7, i % 4) for i in range(1, 41)])
    got, want = _both(spark, "topk_neighbours", folder)
    assert got == want and len(got) == 400
