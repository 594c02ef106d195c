"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards, and steps scan one shard each, round and
round. Words are counted from the first step on. A longer phrase becomes active
as soon as both phrases that it is made of (all but its last word, all but its
first) have reached the threshold, which may be in the middle of a round, and
then it is counted for exactly one full cycle of shards, wherever it began.
Counting ends when no phrase is in the middle of its cycle.

These counts are kept by 25 to 52 bits of a phrase's hash, a byte or two each: a
step's are sorted, packed and compressed by range of the hash, all languages of
a buffer together, and phrases that became active at one step are one cohort,
whose packed counts of a cycle are merged range by range. Tasks are told what is active by tables of fixed size: for each
bit of the hashes the step since which a phrase there counts as frequent.
Entries never change again, and a phrase's cycle is dated by them alone. So two
phrases that share a hash or a bit start early at worst, and none is lost. A
last scan counts all phrases whose bits are set, by their words and therefore
exactly; it sends them as sorted and compressed lists, one for each language and
range of the hash. The tables do not grow with the corpus; when they fill up, more
phrases are counted than need be.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_join, stage

#: What ends a piece becomes a byte that UTF-8 does not have, a tab a space.
END = b"\xff"
SIGNS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")

#: Bits of a hash that are kept beside those of its range, at least; all bits have as many places as the corpus has words.
KEPT = 20

#: A step that has not come.
NEVER = 255


@dataclass(frozen=True)
class Rules:
    least: int = 10  # occurrences that a candidate has, at most 65,535
    longest: int = 3  # words of a candidate, at most
    first: int = 2_000  # ranks of each language
    contained: int = 50  # percent of its occurrences in one longer candidate at which a phrase is dropped
    shards: int = 2  # shards of a cycle, at most 60; a step's counts are merged with those of a cycle
    bits: int = 25  # the tables have 2**bits entries, at most 2**32, one table for each length
    buffer: int = 3_000_000  # words that a task counts at a time
    part: int = 2_000_000  # words of the corpus for each range of hashes; the last scan's ranges are four times as wide


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts of one language, and the phrases that they make."""

    def __init__(self, lang: str):
        self.lang, self.raw, self.n = lang, [], 0

    def add(self, text: str) -> None:
        # bytes.lower() changes A to Z alone.
        cut = text.encode().lower().translate(SIGNS).replace(END, b" \xff ") + b" \xff"
        self.raw.append(cut)
        self.n += cut.count(b" ")

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length k: where phrases of it begin, among the places of the words, and their hashes there."""
        found = pc.split_pattern(pa.array(self.raw, pa.large_binary()), b" ").flatten().dictionary_encode()
        self.raw = []
        self.words, flat = found.dictionary, found.indices.to_numpy()
        self.names = self.words.to_pylist()
        if b"" in self.names:  # between two blanks
            flat = flat[flat != self.names.index(b"")]
        self.flat, end, begin = flat.astype(np.int64), self.names.index(END), self.lang.encode() + b"\0"
        own = np.fromiter((xxhash.xxh64_intdigest(begin + w) for w in self.names), dtype=np.uint64, count=len(self.names))
        word, is_word = own[flat], flat != end
        fine, h = is_word, word
        for k in range(1, longest + 1):
            if k > 1:
                fine = fine[:-1] & is_word[k - 1 :]
                h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :])
            yield k, fine, h

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.flat[at + j])) for j in range(k)], pa.scalar(b" ", pa.large_binary()))


def _pressed(raw: bytes) -> bytes:
    """Compressed, after four bytes of length: the shuffle's own compression finds little in numbers."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _plain(payload: bytes) -> bytes:
    return pa.decompress(payload[4:], int.from_bytes(payload[:4], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all low bytes, then all higher ones, which are mostly zero."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes of a range (their kept bits), as steps, and their numbers."""
    return _pressed(_planes(np.diff(h, prepend=np.uint64(0)).astype("<u4")) + _planes(np.minimum(n, 65_535).astype("<u2")))


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _plain(payload)
    cut = len(raw) // 6 * 4
    return np.cumsum(_numbers(raw[:cut], "<u4"), dtype=np.uint64), _numbers(raw[cut:], "<u2").astype(np.int64)


def _listed(phrases: pa.Array | list[str], n: np.ndarray) -> bytes:
    """Phrases, which have no line ends, and their numbers; sorted ones are short, as neighbours begin alike."""
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(n)]), pa.array(phrases, pa.large_binary())), pa.scalar(b"\n", pa.large_binary()))[0].as_py()
    return _pressed(len(n).to_bytes(4, "little") + _planes(n.astype("<u4")) + text)


def _unlisted(payload: bytes) -> pa.Table:
    raw = _plain(payload)
    cut = 4 + 4 * int.from_bytes(raw[:4], "little")
    phrases = pc.split_pattern(pa.array([raw[cut:]], pa.large_binary()), b"\n").flatten()
    return pa.table({"phrase": phrases.cast(pa.large_string()).cast(pa.string()), "n": pa.array(_numbers(raw[4:cut], "<u4").astype(np.int64))})


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, each once, and the sums of their numbers."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


def _blocks(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where each value of ``part`` goes, which is in order."""
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return zip(cuts[:-1], cuts[1:], strict=True)


class Active:
    """Since which step the phrases of each length are active, by bits of their parts' hashes."""

    def __init__(self, tables: list[np.ndarray], bits: int):
        self.tables, self.shift = tables, np.uint64(64 - bits)

    def since(self, k: int, h: np.ndarray) -> np.ndarray:
        """Of phrases of k words: the step since which they count as frequent."""
        return self.tables[k - 1][(h >> self.shift).astype(np.int64)]


def _batches(batches, rules: Rules, drained):
    """Texts by language into buffers, and what ``drained`` makes of all languages when they are full."""
    held: dict[str, Words] = {}

    def flushed():
        some = list(held.values())
        held.clear()  # drained() takes them out one by one, so that memory of those that are done is free
        yield from drained(some)
        pa.default_memory_pool().release_unused()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if lang not in held:
                held[lang] = Words(lang)
            held[lang].add(text)
            if sum(w.n for w in held.values()) > rules.buffer:
                yield from flushed()
    yield from flushed()


def _told(spark, tables: list[np.ndarray]) -> Broadcast:
    """Tables of fixed size, compressed while they are sparse."""
    return spark.sparkContext.broadcast([zlib.compress(t, 1) for t in tables])


def _scan(shard: DataFrame, rules: Rules, step: int, shared: Broadcast, part_bits: int, kept: int) -> DataFrame:
    """(k, since, part, counts): the packed counts of a shard's active phrases, by cohort and range of hashes."""

    def counted(batches):
        active = Active([np.frombuffer(zlib.decompress(t), dtype=np.uint8) for t in shared.value], rules.bits)

        def drained(held: list[Words]):
            found: dict[tuple[int, int], list] = {}  # by length and cohort
            while held:
                words = held.pop()
                before = None  # since when each shorter phrase counts as frequent, by place
                for k, fine, h in words.phrases(rules.longest):
                    since = np.zeros(len(h), dtype=np.uint8) if before is None else np.maximum(before[:-1], before[1:])
                    live = fine & (since <= step) & (step < since.astype(np.int64) + rules.shards)
                    for cohort in np.unique(since[live]).tolist():
                        found.setdefault((k, cohort), []).append(np.unique(h[live & (since == cohort)], return_counts=True))
                    if k < rules.longest:
                        before = np.where(fine, active.since(k, h), np.uint8(NEVER))
                        if not (before <= step).any():
                            break
            for (k, cohort), some in found.items():
                # Hashes that differ only beyond these bits are one.
                h, n = _summed(np.concatenate([f[0] for f in some]) >> np.uint64(64 - part_bits - kept), np.concatenate([f[1] for f in some]))
                part, low = (h >> np.uint64(kept)).astype(np.int64), h & np.uint64((1 << kept) - 1)
                payloads = [(part[i], _packed(low[i:j], n[i:j])) for i, j in _blocks(part)]
                for lo in range(0, len(payloads), 4_096):
                    parts, counts = zip(*payloads[lo : lo + 4_096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int32()), pa.array([cohort] * len(parts), pa.int32()), pa.array(parts, pa.int64()), pa.array(counts, pa.binary())], names=["k", "since", "part", "counts"])

        yield from _batches(batches, rules, drained)

    return shard.mapInArrow(counted, "k int, since int, part long, counts binary")


def _reached(counts: DataFrame, rules: Rules, part_bits: int, kept: int) -> list[np.ndarray]:
    """For each length the bits of phrases that reached the threshold in their
    cycle so far; in pieces of 4 KB, 2**bits / 32768 rows at most for each length."""

    def merged(key, table):
        found = [_unpacked(x) for x in table.column("counts").to_pylist()]
        h, n = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        often = h[n >= rules.least]
        whole = (np.uint64(key[2].as_py()) << np.uint64(64 - part_bits)) | ((often << np.uint64(64 - kept)) >> np.uint64(part_bits))
        bits = np.unique(whole >> np.uint64(64 - rules.bits)).astype(np.int64)
        return pa.table({"k": pa.array(np.full(len(bits), key[0].as_py(), dtype=np.int32)), "bit": pa.array(bits)})

    places = counts.groupBy("k", "since", "part").applyInArrow(merged, "k int, bit long")
    some = places.groupBy("k", F.floor(F.col("bit") / 32_768).alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    out = [np.zeros(1 << rules.bits, dtype=bool) for _ in range(rules.longest)]
    for r in some.collect():
        piece = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little")
        at = r["piece"] * 32_768
        out[r["k"] - 1][at : at + 32_768] |= piece[: (1 << rules.bits) - at].astype(bool)
    return out


def _active(texts: DataFrame, rules: Rules, size: int, part_bits: int) -> list[np.ndarray]:
    """All steps: for each length the table of the steps since which its phrases
    count as frequent. size: words of the corpus, at most about so many."""
    spark = texts.sparkSession
    kept = min(32, max(KEPT, size.bit_length() - part_bits, rules.bits - part_bits))  # the tables' bits are among those that are kept
    tables = [np.full(1 << rules.bits, NEVER, dtype=np.uint8) for _ in range(rules.longest)]
    steps: list[DataFrame] = []
    step = latest = 0  # latest: when the last cohort began
    while step < latest + rules.shards:
        shared = _told(spark, tables[:-1])
        steps.append(stage(_scan(texts.filter(F.col("shard") == step % rules.shards), rules, step, shared, part_bits, kept), f"phrases-{step}"))
        shared.destroy()
        # Cohorts whose cycle is over have told all that they had to.
        open_, cycle = steps[-1], steps[-rules.shards :]
        for earlier in cycle[:-1]:
            open_ = open_.union(earlier)
        reached = _reached(open_.filter(F.col("since") > step - rules.shards), rules, part_bits, kept)
        step += 1
        for k, (table, bits) in enumerate(zip(tables, reached, strict=True), 1):
            fresh = bits & (table == NEVER)
            if fresh.any():
                table[fresh] = step
                latest = step if k < rules.longest else latest
    return tables


def phrase_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, k, phrase, n): exact counts of every word and phrase of up to
    ``longest`` words with at least ``least`` occurrences; others whose hashes
    have a bit of one of them may be there with their exact counts too. k = 0 has the number
    of all words."""
    if rules.least > 65_535 or rules.shards > 60:
        raise ValueError("at most 65,535 occurrences and 60 shards")
    # A step reads the documents as they are and leaves out other shards' rows: a copy by shard would be as large as they.
    shard = F.pmod(F.xxhash64("lang", "text"), F.lit(rules.shards)).cast("int")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("shard", shard)
    size = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 4
    part_bits = min(32, max(4, (size // rules.part).bit_length()))
    tables = _active(texts, rules, size, part_bits)
    list_bits = max(4, part_bits - 2)
    shared = _told(docs.sparkSession, [(t != NEVER).astype(np.uint8) for t in tables])

    def counted(batches):
        active = Active([np.frombuffer(zlib.decompress(t), dtype=np.uint8) for t in shared.value], rules.bits)

        def listed(words: Words) -> pa.Table:
            often = None  # where each shorter phrase may be frequent
            found = []  # of each length: ranges, phrases, numbers
            for k, fine, h in words.phrases(rules.longest):
                if k == 1:
                    found.append(([0], [b""], [int(fine.sum())]))
                # Of a frequent phrase both parts are frequent: others that share its bit are left out.
                at = np.flatnonzero(fine if often is None else fine & often[:-1] & often[1:])
                at = at[active.since(k, h[at]) == 1]
                often = np.zeros(len(fine), dtype=bool)
                often[at] = True
                if not len(at):
                    break  # a longer phrase has frequent parts
                # Numbers of phrases within the buffer, from those of their words.
                code, names = words.flat[at], len(words.names)
                for j in range(1, k):
                    _, code = np.unique(code * names + words.flat[at + j], return_inverse=True)
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                at = at[first]
                found.append(((h[at] >> np.uint64(64 - list_bits)).astype(np.int64), words.text(at, k), n))
            part, phrases, n = (pa.chunked_array([pa.array(f[i], kind) for f in found]) for i, kind in enumerate((pa.int64(), pa.large_binary(), pa.int64())))
            return pa.table({"part": part, "phrase": phrases, "n": n})

        def drained(held: list[Words]):
            while held:
                lang, found = held[-1].lang, listed(held.pop())
                found = found.sort_by([("part", "ascending"), ("phrase", "ascending")])
                part, phrases, n = found["part"].to_numpy(), found["phrase"].combine_chunks(), found["n"].to_numpy()
                payloads = [(part[i], _listed(phrases[i:j], n[i:j])) for i, j in _blocks(part)]
                for lo in range(0, len(payloads), 1_024):
                    parts, lists = zip(*payloads[lo : lo + 1_024], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(parts, pa.int64()), pa.array(lists, pa.binary())], names=["lang", "part", "phrases"])

        yield from _batches(batches, rules, drained)

    def merged(key, table):
        found = pa.concat_tables([_unlisted(x) for x in table.column("phrases").to_pylist()])
        found = found.group_by("phrase").aggregate([("n", "sum")])
        phrase, n = found["phrase"], found["n_sum"]
        k = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        out = pa.table({"lang": pa.array([key[0].as_py()] * len(n), pa.string()), "k": k, "phrase": phrase, "n": n})
        return out.filter(pc.or_(pc.equal(k, 0), pc.greater_equal(n, rules.least)))

    found = texts.drop("shard").mapInArrow(counted, "lang string, part long, phrases binary")
    found = found.groupBy("lang", "part").applyInArrow(merged, "lang string, k int, phrase string, n long")
    # The tables are needed until this is written.
    out = stage(found, "phrases")
    shared.destroy()
    return out


def _joined(rows: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    """The counts of a part of each candidate (lang, phrase, ...); frequent parts
    are dealt over tasks. Written out, as dealing reads its rows three times."""
    table = counts.select(F.struct("lang", "phrase").alias("key_"), F.col("n").alias(name))
    keyed = rows.withColumn("key_", F.struct(F.col("lang"), part.alias("phrase"))).drop("lang")
    met = dealt_join(keyed, table, "key_", "phrase")
    return stage(met.select(F.col("key_.lang").alias("lang"), *[c for c in met.columns if c != "key_"]), "parts")


def collocations(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Null languages are ``und``, null texts are empty. Texts are lower-cased in
    A to Z, cut at punctuation and line ends, and cut into words at spaces and
    tabs. A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is
    a candidate; each cut of it into two parts with l and r occurrences scores
    floor(1000000 * a * a / (l * r)), the least scoring cut counts (ties: the
    first), and candidates of which a longer one holds ``contained`` percent of
    the occurrences are dropped. Ties in score go to the more frequent, then the
    lesser phrase. Repeated rows count each time; columns other than lang and
    text are not read; an empty table gives no rows. Products are decimals of 38
    digits, exact for phrases of up to 10**15 occurrences.
    """
    counts = phrase_counts(docs, rules)
    words = counts.filter("k = 0").select("lang", F.col("n").alias("words"))
    often = counts.filter((F.col("k") > 0) & (F.col("n") >= rules.least))
    candidates = often.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # Whether a longer candidate holds too many of a phrase's occurrences: each tells the phrases inside it.
    inside = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " ")))))
    told = candidates.filter("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    told = told.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(told, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {rules.contained} * a").drop("longer")
    cuts = stage(kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")), "cuts")
    parts = often.filter(F.col("k") < rules.longest)  # the longest are part of none
    first = F.expr("substring_index(phrase, ' ', cut)")
    rest = F.expr("substring(phrase, length(substring_index(phrase, ' ', cut)) + 2)")
    scored = _joined(_joined(cuts, parts, first, "l"), parts, rest, "r")
    wide = lambda x: F.col(x).cast("decimal(15,0)")
    scored = scored.select("*", *[wide(x).alias(f"{x}_") for x in "alr"])
    scored = scored.withColumn("score", F.expr("(a_ * a_ * cast(1000000 as decimal(7, 0))) div (l_ * r_)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of 64 parts of each language, then of the language: no task sorts all of its phrases.
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= rules.first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= rules.first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc, i, unnest(regexp_extract_all(piece, '[^ \t]+')) AS word, generate_subscripts(regexp_extract_all(piece, '[^ \t]+'), 1) AS pos
  FROM (SELECT lang, doc, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
    FROM (SELECT lang, row_number() OVER () AS doc, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS parts FROM documents))),
g AS (SELECT lang, word AS w1, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM pieces WINDOW w AS (PARTITION BY doc, i ORDER BY pos)),
c1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
c2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
c3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c1 GROUP BY 1),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY 1, 2, 3),
cuts AS (
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, c2.f AS a, 1 AS cut, x.f AS l, y.f AS r
  FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.w1 = c2.w1 JOIN c1 y ON y.lang = c2.lang AND y.w1 = c2.w2
  LEFT JOIN longer z ON z.lang = c2.lang AND z.w1 = c2.w1 AND z.w2 = c2.w2 WHERE z.f IS NULL OR 100 * z.f < 50 * c2.f
  UNION ALL SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, 1, x.f, y.f
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.w1 = c3.w1 JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, 2, x.f, y.f
  FROM c3 JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2 JOIN c1 y ON y.lang = c3.lang AND y.w1 = c3.w3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
