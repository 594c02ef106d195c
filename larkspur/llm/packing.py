"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids and an end id; longer ones than a sequence are cut
into whole sequences, the first piece taking what is left over. Packing the
pieces needs their lengths only, and pieces of one length are alike, so the
whole corpus is a histogram of at most 1024 counts, whatever its size.

An individual is a packing: patterns of lengths that fill a sequence, with how
often each is used. The first ones are best fits, of the whole or of random
parts, and fills of least slack (the longest piece with the pieces that fill
its room exactly). Crossover injects whole well-filled sequences of one parent
into the other, takes the pieces that are now there twice out of the other's
sequences, and best-fits the pieces of those that fell apart, longest first.
Islands evolve side by side as Spark tasks; after each epoch every island
receives its neighbour's elite. The best packing is then a table of runs: so
many pieces of a length go to such sequences. Pieces are numbered within their
length (in salted groups, as most may have one length), and each number takes
the place that the run around it says.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Store, byte_letters, pretokens
from .shared import stage

Pattern = tuple[int, ...]


@dataclass(frozen=True)
class Evolution:
    islands: int = 6
    population: int = 6
    generations: int = 8
    epochs: int = 3
    seed: int = 42
    #: Fill from which a sequence counts as well filled.
    good: float = 0.99


def best_fit(packing: Counter, loose: dict[int, int], size: int) -> Counter:
    """Put loose pieces, longest first, where they leave the least room."""
    room: dict[int, Counter] = {}
    for pattern, n in packing.items():
        room.setdefault(size - sum(pattern), Counter())[pattern] += n
    rooms = sorted(room)
    for length in sorted(loose, reverse=True):
        left = loose[length]
        while left > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # New sequences, each with as many as it holds.
                each = size // length
                full, rest = divmod(left, each)
                new = [((length,) * each, full)] * (full > 0) + [((length,) * rest, 1)] * (rest > 0)
                left = 0
            else:
                free = rooms[at]
                pattern, n = next(iter(room[free].items()))
                each = free // length
                used = min(n, left // each)
                if used == 0:
                    used, each = 1, left
                room[free][pattern] -= used
                if room[free][pattern] == 0:
                    del room[free][pattern]
                    if not room[free]:
                        del room[free]
                        rooms.pop(at)
                new = [(tuple(sorted((*pattern, *(length,) * each), reverse=True)), used)]
                left -= used * each
            for pattern, n in new:
                free = size - sum(pattern)
                if free not in room:
                    room[free] = Counter()
                    bisect.insort(rooms, free)
                room[free][pattern] += n
    out: Counter = Counter()
    for patterns in room.values():
        out.update(patterns)
    return out


def fitness(packing: Counter, size: int) -> tuple[int, float]:
    """Few sequences first; then well-filled ones (fills squared), so that what room there is lies together."""
    return -sum(packing.values()), sum(n * (sum(p) / size) ** 2 for p, n in packing.items())


def crossover(one: Counter, other: Counter, size: int, good: float, rng: np.random.Generator) -> Counter:
    """``one`` with well-filled sequences of ``other`` injected."""
    need: Counter = Counter()
    for pattern, n in one.items():
        for length in pattern:
            need[length] += n
    child: Counter = Counter()

    def take(pattern: Pattern, most: int) -> None:
        counts = Counter(pattern)
        n = min(most, *(need[length] // k for length, k in counts.items()))
        if n > 0:
            child[pattern] += n
            for length, k in counts.items():
                need[length] -= n * k

    filled = [p for p in other if sum(p) >= good * size]
    for i in rng.permutation(len(filled)):
        if rng.random() < 0.5:
            take(filled[i], other[filled[i]])
    # What is left of ``one``: its sequences without pieces that were injected,
    # the fullest first; some of the worst are given up in any case (mutation).
    rest = sorted(one, key=lambda p: (sum(p), p), reverse=True)
    for pattern in rest:
        if sum(pattern) >= good * size or rng.random() < 0.8:
            take(pattern, one[pattern])
    return best_fit(child, {k: n for k, n in need.items() if n > 0}, size)


def least_slack(loose: dict[int, int], size: int, rng: np.random.Generator) -> Counter:
    """Sequences around the longest piece left, with what fills its room best.

    A pattern is used as often as its lengths last, so each uses one up: there
    are no more patterns than lengths.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in loose.items():
        left[length] = n
    packing: Counter = Counter()

    def pair(room: int) -> tuple[int, int] | None:
        both = np.flatnonzero((left[: room + 1] > 0) & (left[room::-1] > 0))
        both = both[(both * 2 > room) | ((both * 2 == room) & (left[both] > 1))]
        # The longest pieces are the hardest to place, so they mostly go first.
        return None if len(both) == 0 else (int(b := both[-1 - min(rng.geometric(0.7) - 1, len(both) - 1)]), room - int(b))

    def rest(room: int) -> list[int]:
        if room == 0:
            return []
        if left[room] > 0:
            return [room]
        if two := pair(room):
            return list(two)
        for tried, third in enumerate(np.flatnonzero(left[1:room])[::-1] + 1):
            left[third] -= 1
            two = pair(room - int(third))
            left[third] += 1
            if two:
                return [int(third), *two]
            if tried == 24:
                break
        fits = np.flatnonzero(left[: room + 1])
        if len(fits) == 0:
            return []
        longest = int(fits[-1])
        left[longest] -= 1
        found = [longest, *rest(room - longest)]
        left[longest] += 1
        return found

    while len(there := np.flatnonzero(left)):
        longest = int(there[-1])
        left[longest] -= 1
        pattern = [longest, *rest(size - longest)]
        left[longest] += 1
        counts = Counter(pattern)
        n = min(int(left[length]) // k for length, k in counts.items())
        packing[tuple(sorted(pattern, reverse=True))] += n
        for length, k in counts.items():
            left[length] -= n * k
    return packing


def _started(lengths: dict[int, int], size: int, rng: np.random.Generator, kind: int) -> Counter:
    """A first individual: the best fit, a fill of least slack, or a best fit of random parts."""
    if kind == 0:
        return best_fit(Counter(), lengths, size)
    if kind % 2:
        return least_slack(lengths, size, rng)
    # Random parts one after another give other best fits than the whole at once.
    packing: Counter = Counter()
    first = {k: int(rng.integers(0, n + 1)) for k, n in lengths.items()}
    for part in (first, {k: n - first[k] for k, n in lengths.items()}):
        packing = best_fit(packing, {k: n for k, n in part.items() if n > 0}, size)
    return packing


def _packed(text: str) -> Counter:
    return Counter({tuple(p): n for p, n in json.loads(text)})


def evolve(spark: SparkSession, lengths: dict[int, int], size: int, evolution: Evolution = Evolution()) -> Counter:
    """A packing of so many pieces of each length into sequences of ``size``."""
    if not lengths:
        return Counter()
    least = -(-sum(k * n for k, n in lengths.items()) // size)
    elites: list[str | None] = [None] * evolution.islands
    best = best_fit(Counter(), lengths, size)
    for epoch in range(evolution.epochs):
        arrivals, e = list(elites), evolution

        def island(frames, arrivals=arrivals, epoch=epoch, e=e):
            for frame in frames:
                for i in frame["id"]:
                    rng = np.random.Generator(np.random.PCG64([e.seed, epoch, int(i)]))
                    crowd = [_packed(x) for x in {arrivals[i], arrivals[i - 1]} - {None}]
                    crowd += [_started(lengths, size, rng, k) for k in range(len(crowd), e.population)]
                    for _ in range(e.generations):
                        crowd.sort(key=lambda p: fitness(p, size), reverse=True)
                        crowd = crowd[: max(2, e.population // 2)]
                        parents = len(crowd)
                        while len(crowd) < e.population:
                            a, b = rng.choice(parents, 2, replace=False)
                            crowd.append(crossover(crowd[a], crowd[b], size, e.good, rng))
                    top = max(crowd, key=lambda p: fitness(p, size))
                    yield pd.DataFrame({"island": [i], "packing": [json.dumps(sorted(top.items()))]})

        got = spark.range(0, e.islands, 1, e.islands).mapInPandas(island, "island long, packing string").collect()
        for r in got:
            elites[r["island"]] = r["packing"]
        best = max([best, *(_packed(x) for x in elites if x)], key=lambda p: fitness(p, size))
        if sum(best.values()) == least:
            break
    return best


_stores: dict[str, Store] = {}


def _ids_of(path: str):
    """Encoder by the tokenizers library; pretokens are encoded once.

    A miss goes to the library's merges alone: the pretokenizer's other work
    on a text is done by :func:`pretokens`.
    """
    if path not in _stores:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        file = json.loads(tokenizer.to_str())
        before = file["pre_tokenizer"] or {}
        byte_level = file["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        if not byte_level:
            raise ValueError("only plain byte-level tokenizers are handled")
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        letters, merge = dict(enumerate(byte_letters())), tokenizer.model.tokenize
        one = lambda word: array("I", [t.id for t in merge(word.encode().decode("latin-1").translate(letters))]).tobytes()
        whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        _stores[path] = (Store(one), whole, special)
    store, whole, special = _stores[path]

    def ids(text: str) -> bytes:
        if any(s in text for s in special):
            return whole(text)
        return b"".join(map(store.__getitem__, pretokens(text)))

    return ids


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the whole texts; a null text has the end id only."""

    def cut(batches):
        encode = _ids_of(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        def of(text: str) -> list[tuple[int, int, int, int]]:
            ids = encode(text) + end
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
            return [(k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]

        for batch in batches:
            known: dict[str, list] = {}
            at, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                if text not in known:
                    known[text] = of(text)
                found += known[text]
                at += [row] * len(known[text])
            piece, start, length, crc = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def runs(packing: Counter) -> pd.DataFrame:
    """The packing as runs: pieces first to last of a length, ``each`` of them
    in a sequence, from ``sequence`` on and there from ``offset`` on."""
    rows, sequence, used = [], 0, Counter()
    for pattern, n in sorted(packing.items()):
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], used[length] + n * each - 1, each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "sequence", "offset"], dtype="int64")


#: Numbers of a length that are looked up together, so that no length is one task.
STRETCH = 512


def placed(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """``numbered`` pieces (length, number) with sequence_id and offset from the
    runs around their numbers: the last run that begins at or before each."""
    pieces_ = numbered.withColumn("stretch", F.floor(F.col("number") / STRETCH)).withColumn("run", F.lit(None).cast("struct<first:bigint,each:bigint,sequence:bigint,offset:bigint>"))
    # A run begins anew in each stretch that it reaches.
    stretches = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH)))
    cut = found.withColumn("stretch", stretches).select("length", "stretch", F.greatest("first", F.col("stretch") * STRETCH).alias("number"), F.struct("first", "each", "sequence", "offset").alias("run"))
    order = Window.partitionBy("length", "stretch").orderBy("number", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = pieces_.unionByName(cut, allowMissingColumns=True).withColumn("run_", F.last("run", ignorenulls=True).over(order)).filter(F.col("run").isNull())
    nth = F.col("number") - F.col("run_.first")
    sequence = F.col("run_.sequence") + F.floor(nth / F.col("run_.each"))
    offset = F.col("run_.offset") + nth % F.col("run_.each") * F.col("length")
    return both.withColumn("sequence_id", sequence).withColumn("offset", offset).drop("number", "stretch", "run", "run_")


def pack(docs: DataFrame, path: str, size: int = 1024, evolution: Evolution = Evolution()) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    ``docs`` has doc_id and text; other columns are not read. A null or empty
    text is a piece of its end id alone; repeated rows each have pieces of
    their own; an empty table gives no rows. Of the corpus only the histogram
    of lengths (at most ``size`` counts) and packings of it (patterns with
    their counts) pass through the driver.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, size), "pieces")
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = stage(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = runs(evolve(spark, lengths, size, evolution))
    found = stage(spark.createDataFrame(found, "length long, first long, last long, each long, sequence long, offset long"), "runs")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(within) - 1).join(offsets, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    return placed(numbered, found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
