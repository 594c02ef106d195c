"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pytest

from larkspur.plans import catalogue
from larkspur.session import TABLES

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_distances_and_moments_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.array([r["embedding"] for r in rows], dtype=float)
    d2 = ((v[:, None] - v[None]) ** 2).sum(-1)[np.triu_indices(len(v), 1)]
    got = catalogue.queries()["rms_spread"](spark, SF).first()["diversity"]
    assert abs(got - np.sqrt(d2.mean())) < 1e-4 and got > np.sqrt(d2).mean()
    even = np.array([r["label"] % 2 == 0 for r in rows])
    a, b = v[even], v[~even]
    ca, cb = np.cov(a.T), np.cov(b.T)
    vals, vecs = np.linalg.eigh(ca)
    half = vecs @ np.diag(np.sqrt(np.maximum(vals, 0))) @ vecs.T
    root = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ cb @ half), 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root
    assert abs(catalogue.queries()["frechet_distance"](spark, SF).first()[0] - want) < 1e-4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
