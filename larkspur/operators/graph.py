"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import staged


def star_edges(df: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Edges from the least member of each group to the others, for each kind of group."""
    edges = None
    for g in groups:
        members = df.filter(F.col(g).isNotNull()).select(key, F.col(g).cast("string").alias("g"))
        hubs = members.groupBy("g").agg(F.min(key).alias("u"))
        some = members.join(hubs, "g").filter(F.col(key) != F.col("u")).select("u", F.col(key).alias("v"))
        edges = some if edges is None else edges.union(some)
    return edges.distinct()


def components(edges: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """(key, component): the least id that a vertex is connected to.

    Rounds of two steps until the edges stay as they are: every vertex's greater
    neighbours are tied to its least one (large star), then its lesser
    neighbours and itself (small star). Edges become stars around the least ids
    in a number of rounds that grows with the logarithm of the vertices, however
    long the paths are. Edges from or to null are none; each round is written out.
    """
    now = staged(_facing(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _facing(both.filter("b > a").join(least, "a").select("b", F.col("m").alias("a"))).distinct()
        # From here on a is the greater end: small stars are groups by it.
        hubs = large.groupBy(F.col("b").alias("hub")).agg(F.min("a").alias("m"))
        tied = large.join(hubs, F.col("b") == F.col("hub"))
        small = _facing(tied.select("a", F.col("m").alias("b")).union(hubs.select(F.col("hub").alias("a"), F.col("m").alias("b")))).distinct()
        now = staged(small, "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    labels = now.select(F.col("b").alias(key), F.col("a").alias("component"))
    return vertices.select(key).join(labels, key, "left").select(key, F.coalesce("component", key).alias("component"))


def _facing(edges: DataFrame) -> DataFrame:
    """Edges from their lesser end ``a`` to the greater ``b``; loops and null ends go."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
