"""MinHash near-duplicates by DartMinHash.

A text is its set of five-word shingles; each shingle is a column of weight
(1 in a set, its count in a multiset) cut into unit cells, and every cell of
weight by every unit of rank is a region into which a hash throws Poisson(1)
darts. A dart has a rank and a coordinate of the signature; the earliest dart
of each coordinate is kept. Regions are thrown in order of rank until every
coordinate has one, so a signature of K coordinates costs about N + K log K
darts rather than N * K hashes, and two texts agree in a coordinate with
probability equal to their (weighted) Jaccard similarity.

Coordinates are joined in bands. Equal texts are one row from the start. The
texts in a band's bucket are compared with the one among them that meets most
others anywhere (in a group of edited copies, the one closest to their common
source), so a group costs rows in proportion to its size. Texts of buckets
that are in several classes after that are joined by prefix filter: ordered by
rarity, two sets of similarity t share one of their first (1 - t)n + 1
shingles, and shingles of one class only come first, so a copy with many edits
of its own meets nobody. That join is exact; all links are verified on the
whole shingle sets. Classes are the connected components of the links.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_join, stage


@dataclass(frozen=True)
class Banding:
    """Bands of rows coordinates: a pair of similarity s meets with probability
    1 - (1 - s**rows)**bands, at 0.8 all but 3 in a million."""

    bands: int = 24
    rows: int = 4
    words: int = 5
    similarity: float = 0.8
    weighted: bool = False


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, worked out once each, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of so many words; of the whole text if it has fewer; none without words."""
    got = text.split() if text else []
    h = np.fromiter(map(known.__getitem__, got), dtype=np.uint64, count=len(got))
    if len(h) == 0:
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(words, len(h))):
        out = _mix(out + h[j : j + n] + _GOLD)
    return out


#: Chance of at most k darts in a region of unit area.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart's hash in each of k coordinates (elements: not empty).

    Weights may be any positive numbers: a dart whose place in its cell lies
    above the element's weight misses.
    """
    with np.errstate(over="ignore"):
        cells = np.ceil(weights).astype(np.int64)
        which = np.repeat(np.arange(len(elements)), cells)
        level = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = _mix(elements[which] + _mix(level.astype(np.uint64) + _GOLD))
        room = weights[which] - level
        best, value = np.full(k, np.inf), np.zeros(k, dtype=np.uint64)
        total, start = float(weights.sum()), 0
        step = max(1, math.ceil((k * math.log(k) + 2 * k) / total))
        while np.isinf(best).any():
            ranks = np.arange(start, start + step, dtype=np.uint64)
            region = _mix(cell[:, None] ^ _mix(ranks + np.uint64(1))[None, :] * _GOLD).ravel()
            darts = np.searchsorted(_POISSON, (region >> np.uint64(11)) * 2.0**-53, side="right")
            at = np.repeat(np.arange(len(region)), darts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = _mix(region[at] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
            own = at // step
            if (room < 1).any():
                hit = (_mix(dart ^ np.uint64(0xA5A5)) >> np.uint64(11)) * 2.0**-53 < room[own]
                at, dart, own = at[hit], dart[hit], own[hit]
            rank = ranks[at % step].astype(np.float64) + (dart >> np.uint64(11)) * 2.0**-53
            coord = (_mix(dart + np.uint64(0x5A5A)) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, coord))
            coord, rank, dart = coord[order], rank[order], dart[order]
            first = np.flatnonzero(np.diff(coord, prepend=-1))
            c, r, d = coord[first], rank[first], dart[first]
            won = r < best[c]
            best[c[won]], value[c[won]] = r[won], d[won]
            start += step
            step = min(4 * step, max(step, 65_536 // max(1, len(cell))))
    return value


def band_keys(texts: DataFrame, banding: Banding) -> DataFrame:
    """(doc, hash, bands array<long>) of rows (doc, hash, text); bands is null for texts without words."""
    k = banding.bands * banding.rows

    def keys(batches):
        known = _Words()
        for batch in batches:
            bands = []
            for text in batch.column("text").to_pylist():
                all_of = shingles(text, banding.words, known)
                if len(all_of) == 0:
                    bands.append(None)
                    continue
                elements, counts = np.unique(all_of, return_counts=True)
                sig = signature(elements, counts.astype(float) if banding.weighted else np.ones(len(elements)), k)
                key = np.zeros(banding.bands, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(banding.rows):
                        key = _mix(key + sig[j :: banding.rows] + _GOLD)
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hash"), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "hash", "bands"])

    return texts.select("doc", "hash", "text").mapInArrow(keys, "doc long, hash binary, bands array<long>")


def _sets(texts: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(id, shingles): the distinct 64-bit hashes of each text's shingles; in a
    multiset, the second and later ones hash with their number."""

    def build(batches):
        known = _Words()
        for batch in batches:
            lists = []
            for text in batch.column("text").to_pylist():
                elements, counts = np.unique(shingles(text, words, known), return_counts=True)
                if weighted:
                    which = np.repeat(np.arange(len(elements)), counts)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                    with np.errstate(over="ignore"):
                        elements = np.where(nth > 0, _mix(elements[which] + nth.astype(np.uint64)), elements[which])
                lists.append(elements.view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(flat))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(build, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar; ``a`` may be a hot key."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    sizes = (F.size("x") >= similarity * F.size("y")) & (F.size("y") >= similarity * F.size("x"))
    # A centre with a third of all pairs is dealt over tasks.
    both = dealt_join(stage(pairs, "pairs"), left, "a", "b").join(right, "b").filter(sizes)
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    # Integer sizes times a short decimal: compare in units of 10**-9 to keep ties exact.
    return both.filter(shared * 1_000_000_000 >= (F.size("x") + F.size("y") - shared) * round(similarity * 1_000_000_000)).select("a", "b")


def across_classes(sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids of different classes that may be as similar, by
    prefix filter over the sets of ``classes`` (id, class): no such pair is missed."""
    ceil = lambda x: F.ceil(x - 1e-9)  # noqa: E731  a hair less, so that prefixes are never too short
    tokens = sets.join(classes, "id").select("id", "class", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("c1"), F.max("class").alias("c2"))
    # Any order that all sets share will do. What one class alone has comes first and joins nothing.
    often = often.select("s", F.when(F.col("c1") == F.col("c2"), 0).otherwise(F.col("df")).alias("df"))
    ordered = tokens.join(often, "s").groupBy("id").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    probe = F.col("n") - ceil(F.col("n") * similarity) + 1
    index = F.col("n") - ceil(F.col("n") * (2 * similarity / (1 + similarity))) + 1
    prefix = ordered.select("id", "class", "n", index.alias("index"), F.posexplode(F.slice("order", 1, probe.cast("int"))).alias("at", "o"))
    prefix = stage(prefix.filter("o.df > 0").select("id", "class", "n", "index", F.col("o.s").alias("s"), F.col("at")), "prefixes")
    small = prefix.filter("at < index").select("s", F.col("id").alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    large = prefix.select("s", F.col("id").alias("b"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)))
    near = (F.col("ca") != F.col("cb")) & order & (F.col("na") >= F.col("nb") * similarity - 1e-9) & enough
    return small.join(large, (small["s"] == large["s"]) & near).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, class) of the links' connected components; the class is the least id.

    Each round every vertex points at the least label around it and at that
    label's own (large stars, then shortcuts), staged in the shared folder;
    rounds grow with the logarithm of a component's width.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    edges = stage(both.filter("u <> v"), "edges")
    labels = stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).select(F.col("u").alias("id"), "l"), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "l"), "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("m"))
        low = labels.join(near, "id", "left").select("id", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        # A whole class hears of the least label that any of its members met.
        hook = low.groupBy("l").agg(F.min("m").alias("h"))
        step = low.join(hook, "l").select("id", F.col("l").alias("was"), F.least("m", "h").alias("m"))
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        now = stage(step.join(jump, "m", "left").select("id", "was", F.least("m", F.coalesce("mm", "m")).alias("l")), "labels")
        labels = now.select("id", "l")
        if now.filter("l <> was").isEmpty():
            return labels.select("id", F.col("l").alias("class"))


def _classes(docs: DataFrame, banding: Banding, key: str) -> tuple[DataFrame, DataFrame]:
    """(doc, hash) of each row, and (hash, doc, copies, class) of each distinct
    text: its least id, its rows and its class."""
    base = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("hash", F.unhex(F.sha2("text", 256)))
    keys = stage(band_keys(base, banding), "bands")
    groups = keys.groupBy("hash").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    groups = stage(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    buckets = groups.select("id", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(buckets.join(shared, ["band", "key"]), "members")
    met = stage(members.groupBy("id").agg(F.sum("size").alias("met")), "met")
    # The copy with the least id stands for its group; dealt by id too, copies don't meet.
    taken = groups.join(met.select("id"), "id").select("hash", "id", F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("doc"))
    once = base.select("hash", F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("doc"), "text").dropDuplicates(["hash", "none", "doc"])
    rows = once.join(taken, ["hash", "none", "doc"]).select("id", "text")
    sets = stage(_sets(rows, banding.words, banding.weighted), "sets")

    def ask(pairs: DataFrame) -> DataFrame:
        return stage(verified(pairs.filter("a <> b").distinct(), sets, banding.similarity), "links")

    centers = members.join(met, "id").groupBy("band", "key").agg(F.max(F.struct("met", "id")).alias("c")).select("band", "key", F.col("c.id").alias("a"))
    links = ask(members.join(centers, ["band", "key"]).select("a", F.col("id").alias("b")))
    labelled = stage(members.join(components(links), "id", "left").withColumn("class", F.coalesce("class", "id")), "labelled")
    split = labelled.groupBy("band", "key").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).filter("c1 <> c2").select("band", "key")
    rest = stage(labelled.join(split, ["band", "key"]).select("id", "class").distinct(), "rest")
    links = stage(links.union(ask(across_classes(sets, rest, banding.similarity))), "links")
    of_group = groups.select("id", "hash", "doc", "copies").join(components(links), "id", "left")
    return keys.select("doc", "hash"), stage(of_group.withColumn("class", F.coalesce("class", "id")), "classes")


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, copies): one row per row of ``docs``.

    class_id is the least id among the documents linked to it, directly or by
    others; copies counts the rows with its own text. How many texts a text is
    near to is not told: within a class not all pairs are compared.
    Equal texts are always one class. A null text counts as empty; texts
    without words are linked to their equals only. Texts of fewer than five
    words are one shingle. A null id never names a class, unless all its ids
    are null; repeated ids keep a row each. Other columns are not read.
    """
    keys, of_group = _classes(docs, banding, key)
    names = of_group.groupBy("class").agg(F.min("doc").alias("class_id"))
    named = of_group.join(names, "class").select("hash", "class_id", "copies")
    return dealt_join(keys, named, "hash", "doc").select(F.col("doc").alias(key), "class_id", "copies")


def first_of_each(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, the one with the least
    id and of these with the least hash of its text. Null ids come last; rows of
    one id with different texts stay or go each with its own class; of rows of
    one id and text the one whose other columns, as JSON, come first stays."""
    _, of_group = _classes(docs, banding, "doc_id")
    first = of_group.groupBy("class").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")).alias("f"))
    first = first.select(F.col("f.doc").alias("doc__"), F.col("f.hash").alias("hash__"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    # The caller's row as a struct: its names meet none of these.
    hashed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"),
        F.col("doc_id").cast("long").alias("id"), (F.to_json(F.struct(*others)) if others else F.lit(0)).alias("order"))
    same = (hashed["hash"] == first["hash__"]) & hashed["id"].eqNullSafe(first["doc__"])
    one = Window.partitionBy("hash", "id").orderBy("order")
    return hashed.join(first, same, "left_semi").withColumn("nth", F.row_number().over(one)).filter("nth = 1").select("row.*")
