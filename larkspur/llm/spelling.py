"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Every word of the vocabulary generates the words that one deletion or one
replacement makes of it (an insertion is a deletion seen from the other word).
They are probed against Bloom filters of the whole vocabulary, one for each
length, in blocks of 64 bits: a probe touches one block. Only the few positives
are shuffled, to an exact join with the vocabulary that removes the false ones.

The filters are broadcast. Their size is bounded: a pass has the filters of at
most ``words`` words, dealt by hash, and a larger vocabulary takes more passes;
each pass probes all words and is written out. All of a pass's filters are
hashed alike: a polynomial over the code points, which every edit changes by one
term or one shift, so a word's edits are hashed together as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: In UTF-8, U+00C0 to U+00FF are C3 80 to C3 BF.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
DIVISOR = 97

BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sizes:
    """Of words: those counted, and what a pass of the filters takes. The last two change no result."""

    letters: int = 5
    least: int = 3
    words: int = 8_000_000  # words of a pass: at 32 bits 32 MB are broadcast
    bits: int = 32  # bits of a filter for each of its words


def word_counts(docs: DataFrame, sizes: Sizes = Sizes(), buffer: int = 400_000) -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    Words are maximal runs of letters A to Z, a to z and U+00C0 to U+00FF,
    lower-cased in A to Z. Where 97 divides crc32 of ``<doc_id>:<run>``, the
    code point at that hash modulo the length is left out. Runs of the same
    document are alike, so each is hashed once for a document.
    """

    def counted(batches):
        held: Counter[bytes] = Counter()

        def drained():
            words = list(held)
            for lo in range(0, len(words), 65_536):
                some = words[lo : lo + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in some], pa.string()), pa.array([held[w] for w in some], pa.int64())], names=["word", "n"])
            held.clear()

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower())).items():
                    h = zlib.crc32(run, begin)
                    if h % DIVISOR == 0:
                        points = run.decode()
                        at = h % len(points)
                        run = (points[:at] + points[at + 1 :]).encode()
                    if len(run) >= sizes.letters:  # code points are checked after the sum
                        held[run] += n
                if len(held) > buffer:
                    yield from drained()
        yield from drained()

    texts = docs.filter("text is not null").select("doc_id", "text")
    counts = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= sizes.least) & (F.length("word") >= sizes.letters))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of polynomial hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]), dtype=np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Unmixed hashes of words of one length, as rows of code points."""
    return (codes.astype(np.uint64) * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each mixed hash, and its five bits there."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(len(h), dtype=np.uint64)
    for i in range(5):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return block.astype(np.int64), mask


def blocks_of(n: int, sizes: Sizes) -> int:
    return max(1, -(-n * sizes.bits // 64))


def _filters(vocabulary: DataFrame, counts: dict[int, int], sizes: Sizes) -> dict[int, np.ndarray]:
    """A filter for each length, put together from pieces of 4 KB."""

    def bits(batches):
        for b in batches:
            words, lengths = np.array(b.column("word").to_pylist(), dtype=object), b.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                some = words[lengths == length].tolist()
                block, mask = _places(_mixed(_hashes(_codes(some, length))), blocks_of(counts[length], sizes))
                for i in range(64):
                    at = block[(mask >> np.uint64(i)) & np.uint64(1) == 1] * 64 + i
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length, np.int32)), pa.array(at)], names=["length", "bit"])

    placed = vocabulary.select("word", "length").mapInArrow(bits, "length int, bit long")
    pieces = placed.groupBy("length", F.floor(F.col("bit") / 32_768).alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    out = {length: np.zeros(blocks_of(n, sizes) * 8, dtype=np.uint8) for length, n in counts.items()}
    for r in pieces.collect():
        at = r["piece"] * 4_096
        piece = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(out[r["length"]]) - at]
        out[r["length"]][at : at + len(piece)] = piece
    return {length: x.view(np.uint64) for length, x in out.items()}


def _passed(h: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the unmixed hashes a filter may have."""
    block, mask = _places(_mixed(h), len(found))
    return (found[block] & mask) == mask


def edits(words: list[str], length: int, shorter: np.ndarray | None, same: np.ndarray | None, alphabet: np.ndarray):
    """(number of the word, edited word, whether a letter was deleted) of all
    deletions and replacements that the filters of their lengths may have.
    Arrays go along the words, or, of few long words, along their places."""
    codes = _codes(words, length)
    terms = codes.astype(np.uint64) * _powers(length)[:-1]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    inverse = np.array([pow(int(BASE), -1, 2**64)], dtype=np.uint64)
    # What is behind a deleted letter moves one place to the front.
    without = upto - terms + (upto[:, -1:] - upto) * inverse
    # Of equal letters in a row leaving out the first is enough.
    fresh = np.concatenate([np.ones((len(words), 1), dtype=bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    blank, power = upto[:, -1:] - terms, _powers(length)[:-1]
    lines = [(slice(None), i) for i in range(length)] if len(words) > length else [(j, slice(None)) for j in range(len(words))]
    numbers, places = np.indices(codes.shape)
    for line in lines:
        at, j, i = codes[line], numbers[line], places[line]

        def hits(h: np.ndarray, fine: np.ndarray, found: np.ndarray, j=j, i=i):
            some = np.flatnonzero(fine)
            some = some[_passed(h[some], found)]
            return zip(j[some].tolist(), i[some].tolist(), strict=True)

        if shorter is not None:
            for n, k in hits(without[line], fresh[line], shorter):
                yield n, words[n][:k] + words[n][k + 1 :], True
        if same is not None:
            for c in alphabet.tolist():
                for n, k in hits(blank[line] + np.uint64(c) * power[i], at != c, same):
                    yield n, words[n][:k] + chr(c) + words[n][k + 1 :], False


def near_words(vocabulary: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(word, other, n): each word with every word one edit away, and how often
    that one occurs. ``vocabulary`` has one row for a word, with its n."""
    spark = vocabulary.sparkSession
    told = vocabulary.withColumn("length", F.length("word"))
    letters = sorted(r["c"] for r in told.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r["c"])  # at most 90
    alphabet = np.array([ord(c) for c in letters], dtype=np.uint32)
    total = vocabulary.count()
    passes = max(1, -(-total // sizes.words))
    dealt = lambda word: F.pmod(F.xxhash64(word), F.lit(passes)).cast("int")
    # Words of one length lie together, so that arrays of a task are long.
    ordered = stage(told.withColumn("dealt", dealt("word")).repartition(F.col("length"), F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(64))).sortWithinPartitions("length"), "vocabulary") if total else told.withColumn("dealt", dealt("word"))
    positives = None
    for i in range(passes):
        of_pass = ordered.filter(F.col("dealt") == i)
        counts = {r["length"]: r["count"] for r in of_pass.groupBy("length").count().collect()}
        filters = _filters(of_pass, counts, sizes)
        # A word that is the only one of its length has nothing to be replaced by.
        alone = {length for length, k in counts.items() if k == 1} if passes == 1 else set()
        shared = spark.sparkContext.broadcast((filters, alone, alphabet))

        def probed(batches, shared=shared):
            filters, alone, alphabet = shared.value
            for b in batches:
                words, lengths = np.array(b.column("word").to_pylist(), dtype=object), b.column("length").to_numpy()
                ns = b.column("n").to_numpy()
                for length in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == length)
                    shorter, same = filters.get(length - 1), None if length in alone else filters.get(length)
                    if shorter is None and same is None:
                        continue
                    at, made, left_out = [], [], []
                    for j, word, deleted in edits(words[own].tolist(), length, shorter, same, alphabet):
                        at.append(j)
                        made.append(word)
                        left_out.append(deleted)
                    at = own[np.array(at, dtype=np.int64)]
                    for lo in range(0, len(at), 65_536):
                        some = at[lo : lo + 65_536]
                        yield pa.RecordBatch.from_arrays([pa.array(words[some].tolist(), pa.string()), pa.array(ns[some], pa.int64()), pa.array(made[lo : lo + 65_536], pa.string()), pa.array(left_out[lo : lo + 65_536], pa.bool_())], names=["from", "from_n", "other", "deleted"])

        found = ordered.select("word", "n", "length").mapInArrow(probed, "from string, from_n long, other string, deleted boolean")
        # What belongs to another pass is a false positive here.
        found = stage(found.filter(dealt("other") == i), f"neighbours-{i}")
        positives = found if positives is None else positives.union(found)
    # The exact join: what is not in the vocabulary was a false positive.
    real = positives.join(vocabulary.select(F.col("word").alias("other"), "n"), "other")
    one = F.struct(F.col("from").alias("word"), F.col("other"), F.col("n"))
    two = F.struct(F.col("other").alias("word"), F.col("from").alias("other"), F.col("from_n").alias("n"))
    return real.select(F.explode(F.when(F.col("deleted"), F.array(one, two)).otherwise(F.array(one))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with forms: the last one on each word's way. Ways
    have no rings, as n doubles at least with every step, and each round halves them."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Each word with its spelling group: word, form, root, n, n_near, form_n.

    A word's form is its near word (one code point inserted, deleted or
    replaced) that occurs most, ties to the first in code-point order, if it
    occurs at least twice as often as the word; its root is the last of the
    forms that follow each other. Null texts have no words; a null doc_id counts
    as an empty one where runs are hashed; repeated rows count each time; very
    long words are words; other columns are not read; an empty table gives no rows.
    """
    vocabulary = stage(word_counts(docs, sizes), "words")
    near = near_words(vocabulary, sizes)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("other"))).alias("b"))
    known = vocabulary.join(best, "word", "left")
    form = -F.col("b.m") >= 2 * F.col("n")
    told = stage(known.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("b.other")).alias("form"), F.when(form, -F.col("b.m")).alias("form_n")), "forms")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
