"""Placement of components in splits: guards, straddling, pinned components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import graph, ranks, splits, timeline
from larkspur.session import staged


def chaining_guard(components: DataFrame, component: str, most: float) -> DataFrame:
    """Rows, components, the largest one's share, and whether it voids the grouping."""
    sizes = components.groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("components"), F.round(share, 6).alias("largest_share"), (share > most).alias("void"))


def straddling(rows: DataFrame, component: str, split: str) -> DataFrame:
    """Components on more than one side, with the fewest moves that mend each."""
    sides = rows.groupBy(component, split).agg(F.count(F.lit(1)).alias("n"))
    return sides.groupBy(component).agg(F.count(F.lit(1)).alias("sides"), (F.sum("n") - F.max("n")).alias("moves")).filter("sides > 1")


def pinned(rows: DataFrame, component: str, pin: str) -> DataFrame:
    """A component follows its pinned members; one pinned to several sides is
    refused, one without pins is free. One row per component."""
    pins = F.array_sort(F.collect_set(pin))
    found = rows.groupBy(component).agg(F.count(F.lit(1)).alias("members"), pins.alias("pins"))
    state = F.when(F.size("pins") == 0, "free").when(F.size("pins") == 1, F.col("pins")[0]).otherwise("refused")
    return found.select(component, "members", state.alias("placement"))


def place_beside_pins(vertices: DataFrame, edges: DataFrame, key: str, pin: str, shares: dict[str, int], to: str | None = None, drop_bridging: bool = False, seed: int = 42) -> DataFrame:
    """Place new vertices (null ``pin``) beside pinned ones, which never move:
    (key, component, split, state), one row per vertex.

    A component with pins of one split takes it whole (``follows``); one without
    pins goes to the split ``to``, or where that is null by the largest deficit
    counted on top of the pinned mass (``placed``), equal sizes by sha256 of
    "seed:least member". A new vertex that joins pins of several splits bridges
    them: that is an error, or with ``drop_bridging`` all new vertices of the
    component are left out (``dropped``, without a split), and components are
    found again without them until none bridges. Pinned vertices of one component on
    several sides keep them (``straddles``). ``vertices`` has each key once;
    edges (u, v) from or to other keys, or null ones, do not count.
    """
    live = staged(vertices.select(key, F.col(pin).alias("pin_")).filter(F.col(key).isNotNull()), "live")
    dropped = live.limit(0).select(key, F.lit(None).cast(live.schema[key].dataType).alias("component"))
    while True:
        ends = lambda e, end: e.join(live.select(F.col(key).alias(end)), end, "left_semi")  # noqa: B023, E731
        found = graph.components(ends(ends(edges.select("u", "v"), "u"), "v"), live, key)
        found = staged(found.join(live, key), "components")
        groups = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count("pin_").alias("pins"), F.min("pin_").alias("side"), F.max("pin_").alias("other"))
        groups = staged(groups, "groups")
        bridging = groups.filter("side <> other and size > pins").select("component")
        bridges = staged(found.filter("pin_ is null").join(bridging, "component", "left_semi").select(key, "component"), "bridges")
        some = sorted(r[0] for r in bridges.limit(3).collect())
        if not some:
            break
        if not drop_bridging:
            raise ValueError(f"new vertices join several pinned splits, among them {some}; placing them would put one component on two sides")
        dropped = dropped.union(bridges)
        live = staged(live.join(bridges, key, "left_anti"), "live")
    free = groups.filter("pins = 0").select("component", "size")
    if to is None:
        held = {r["pin_"]: r["count"] for r in live.filter("pin_ is not null").groupBy("pin_").count().collect()}
        followers = groups.filter("side = other").groupBy("side").agg(F.sum(F.col("size") - F.col("pins")).alias("n"))
        for r in followers.collect():
            held[r["side"]] += r["n"]
        if unknown := set(held) - set(shares):
            raise ValueError(f"pinned to splits without a share: {sorted(unknown)}")
        placed = splits.largest_deficit(free, "component", "size", shares, held, seed).select("component", "split")
    else:
        placed = free.select("component", F.lit(to).alias("split"))
    known = found.join(groups.select("component", "side", "other"), "component").join(placed, "component", "left")
    state = F.when(F.col("side") != F.col("other"), "straddles").when(F.col("pin_").isNotNull(), "pinned").when(F.col("side").isNotNull(), "follows").otherwise("placed")
    out = known.select(key, "component", F.coalesce("pin_", "side", "split").alias("split"), state.alias("state"))
    return out.union(dropped.select(key, "component", F.lit(None).cast("string").alias("split"), F.lit("dropped").alias("state")))


def round_robin(rows: DataFrame, group: str, order: list[str], block: int = timeline.BLOCK) -> DataFrame:
    """Add ``turn``: one row of each group in each turn, in order."""
    return ranks.row_numbers(rows, group, order, "turn", block)


def evenly_spaced(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group, evenly spaced in order, first and last among them."""
    sizes = rows.groupBy(F.col(group).alias("group_")).agg(F.count(F.lit(1)).alias("size_"))
    numbered = ranks.row_numbers(rows, group, order, "at_", timeline.BLOCK).join(sizes, F.col(group).eqNullSafe(F.col("group_")))
    at, size = F.col("at_"), F.col("size_")
    # Row i is taken when the index i * (n - 1) // (size - 1) is first reached there.
    step = F.when(size <= n, F.lit(True)).otherwise((at == 0) | (F.floor(at * (n - 1) / (size - 1)) > F.floor((at - 1) * (n - 1) / (size - 1))))
    return numbered.filter(step).select(*rows.columns)
