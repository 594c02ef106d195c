"""The ten operators against brute force, round trips and held-out accuracy,
and the odd inputs that each must stand: nulls, empty and long texts, ties,
repeated rows, empty tables, and further columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, fingerprints, language, neardup, packing, pii, quality, queries, revisits, secrets, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, score double, kept boolean"
PROSE = "The quick brown fox jumps over the lazy dog while seven old wizards mix a potion of herbs and roots. "


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def table(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 997} x{i}." for i in range(30_000))
    texts = [None, "", " \n\t ", "one", PROSE, PROSE, PROSE * 5, long, "password = hunter22secret é😀", None, "日本語 テキスト"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", -1, 7, 0.5, True) for i, t in enumerate(texts)]
    rows += [(4, PROSE, "en", "s", -1, 7, 0.5, True), (None, PROSE, "en", "s", -1, 7, 0.5, True), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


RUNS = {
    "op1": fingerprints.fingerprint_edits,
    "op2": sharding.sharded_documents,
    "op3": language.identified_documents,
    "op5": neardup.near_duplicates,
    "op6": secrets.scan_documents,
    "op7": lambda d: packing.pack(d, queries.vocabulary()),
    "op8": quality.judged_documents,
    "op9": lambda d: bpe.round_trips(d, queries.vocabulary()),
    "op10": lambda d: pii.pseudonymize(d, b"key"),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(odd, none, name):
    got = RUNS[name](odd).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    want = sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert (sorted(set(ids)) == sorted(set(want))) if name == "op7" else (ids == want)
    assert RUNS[name](none).count() == 0


def test_fingerprints_recover_the_differences(docs, table):
    got = fingerprints.fingerprint_edits(docs, rows_per_range=40).toPandas()
    order = table.sort_values("doc_id", ascending=False).reset_index(drop=True)
    want = {}
    for i, x in enumerate(order.itertuples()):
        other, k = order.text[(i + 1) % len(order)], len(x.text) // 3
        want[x.doc_id] = hashlib.sha256((x.text[: len(x.text) - k] + other[:k]).encode()).hexdigest()
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(table)
    for x in got.itertuples():
        a, b, c = set(x.digests), set(x.edited_digests), set(x.next_digests)
        assert x.edited_sha256 == want[x.doc_id]
        assert set(x.edited_difference) == a ^ b and set(x.next_difference) == a ^ c
        assert abs(x.near_edited - likeness(a, b)) < 1e-12 and abs(x.near_next - likeness(a, c)) < 1e-12
    by_text = dict(zip(table.doc_id, table.text, strict=True))
    for text, prints in got.groupby(got.doc_id.map(by_text)).fingerprint:
        assert prints.nunique() == 1, text


def test_sharding_is_a_seeded_permutation(docs, table):
    one, two = (sharding.sharded_documents(docs, seed=s).toPandas().sort_values("doc_id") for s in (1, 2))
    again = sharding.sharded_documents(docs.repartition(5), seed=1).toPandas().sort_values("doc_id")
    assert (one.slot.values == again.slot.values).all() and (one.shard.values == again.shard.values).all()
    assert (one.slot.values != two.slot.values).any()
    counts = one.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert counts["size"].max() - counts["size"].min() <= 1 and (counts["max"] + 1 == counts["nunique"]).all()
    text = dict(zip(table.doc_id, table.text, strict=True))
    assert all(x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) and x.size == len(text[x.doc_id].encode()) + 1 for x in one.itertuples())


def test_buckets_are_rearranged_whole(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(3).alias("bucket"))
    got = sharding.external_shuffle(df, 8, bucket_bytes=500).toPandas()
    assert sorted(got.doc_id) == list(range(1000)) and got.groupby("shard").slot.nunique().tolist() == [125] * 8


def test_language_held_out_accuracy(docs, table):
    got = language.identified_documents(docs).toPandas().merge(table, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_numbers_are_no_letters(spark):
    """Prediction takes for letters what training does."""
    df = spark.createDataFrame([(i, f"the cat and dog number {i}", "en") for i in range(6)] + [(6, "²½", None), (7, "Ⅷ ③ 12", None), (8, "x²y", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (6, 7, 8)] == ["und", "und", "en"] and got[6]["score"] == 0.0
    assert language.words_of("X²yⅧz_1a") == ["x", "y", "z", "a"]


def test_stray_languages_and_names(spark):
    rows = [(i, f"word{i % 7} a b", "en", 7.0) for i in range(900)] + [(1000 + i, f"mot{i} c", "fr", 7.0) for i in range(400)] + [(2000, "stray one", "xx", 7.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(df)
    assert model.langs == ["en", "fr"]
    kept = language.identify(df, model, "p_", "s_")
    assert kept.columns == ["doc_id", "text", "lang", "score", "p_", "s_"] and kept.filter("score <> 7.0").isEmpty()


def test_unseen_words_fall_back_to_shorter_ngrams(spark):
    rows = [("en", "the thing with other weather")] * 5 + [("fr", "quelque chose avec beaucoup")] * 5
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    scorer = language.Scorer(model)
    assert scorer.predict("thother")[0] == "en" and scorer.predict("quelchose")[0] == "fr"
    assert scorer.predict("12 34 __") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        kind = rng.choice(["response", "revisit"])
        url = rng.choice(["hot", "hot", "b", "c", None])
        rows.append((i, kind, url, rng.choice([None, *range(80)]), rng.choice(["x", "y", None]), rng.choice(["m", None]), {"Date": str(i), "Server": "s"}, f"d{i}", "clash"))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, etag string, modified string, headers map<string,string>, digest string, slice string")
    got = {r["record_id"]: r for r in revisits.resolve(df).collect()}
    assert len(got) == sum(r[1] == "revisit" for r in rows)
    for i, kind, url, at, etag, modified, _, _, _ in rows:
        if kind == "response":
            continue
        earlier = [r for r in rows if r[1] == "response" and None not in (url, at, r[3]) and r[2] == url and r[3] < at]
        last = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        if last is None:
            want = "no earlier response"
        elif (etag == last[4]) if etag is not None else (modified is not None and modified == last[5]):
            want = "resolved"
        else:
            want = "validators differ"
        assert got[i]["status"] == want, (i, last)
        if want == "resolved":
            assert (got[i]["response_id"], got[i]["digest"]) == (last[0], last[7])
            assert got[i]["headers"] == {"date": str(i), "server": "s"}
    assert revisits.resolve(df.limit(0)).count() == 0


def test_headers_fold_and_tags_compare_weakly(spark):
    rows = [
        (1, "response", "u", 1, '"x"', None, {"Date": "1", "date": "2", "Server": "s"}, "d1"),
        (2, "revisit", "u", 5, 'W/"x"', None, {"DATE": "3", "Date": "4", "ETag": '"x"'}, None),
        (3, "revisit", "u", 6, 'W/"y"', None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, etag string, modified string, headers map<string,string>, digest string")
    got = {r["record_id"]: r for r in revisits.resolve(df).collect()}
    assert got[2]["status"] == "resolved" and got[2]["headers"] == {"date": "4", "server": "s", "etag": '"x"'}
    assert got[3]["status"] == "validators differ" and got[3]["headers"] == {}


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://www.A.com:80/x/?b=2&a=1&ref=q#f", "a.com/x?a=1&b=2"), ("https://m.a.com/", "a.com"), (None, None), ("a.com/X", "a.com/X")],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u"))).first()[0] == want


def shingled(text):
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(ids, texts):
    sets, holders, shared, parent = [shingled(t) for t in texts], defaultdict(list), Counter(), list(range(len(ids)))
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                shared[held[b], held[a]] += 1

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    first = {}
    for i in range(len(ids)):
        first.setdefault(root(i), []).append(ids[i])
    return {d: min(v) for v in first.values() for d in v}


def test_near_duplicates_against_brute_force(docs, table):
    got = neardup.near_duplicates(docs).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == brute_classes(list(table.doc_id), list(table.text))


def test_near_duplicates_tell_only_what_brute_force_confirms(spark):
    """Edited copies of one source: every column is known from all pairs."""
    rng = random.Random(8)
    source = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = []
    for i in range(40):
        words = list(source)
        words[rng.randrange(300)] = f"x{i}"
        rows += [(i, " ".join(words))] * (1 + i % 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got.columns) == ["class_id", "copies", "doc_id"]
    classes, copies = brute_classes([r[0] for r in rows], [r[1] for r in rows]), Counter(r[1] for r in rows)
    want = sorted((d, classes[d], copies[t]) for d, t in rows)
    assert sorted((r["doc_id"], r["class_id"], r["copies"]) for r in got.collect()) == want


def test_chains_of_near_copies_lose_no_link(spark):
    """Each text differs a little from the last, so ends of a chain share nothing."""
    rng = random.Random(2)
    words, rows = [f"w{rng.randrange(10**9)}" for _ in range(200)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = [*words[4:], *(f"w{rng.randrange(10**9)}" for _ in range(4))]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == brute_classes([r[0] for r in rows], [r[1] for r in rows])
    assert set(got.class_id) == {0} and got[got.doc_id >= 100].copies.eq(41).all()


def test_one_document_of_each_class_stays(spark):
    """Repeated ids with different texts, and near copies without ids."""
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(120)) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (None, c), (None, c + " end"), (None, c), (None, a), (None, None), (3, "")]
    got = neardup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(1, a), (2, b), (3, "")]
    assert [r["text"] in (c, c + " end") for r in got if r["doc_id"] is None] == [True]


@pytest.mark.parametrize("kind", ["set", "counts", "reals"])
def test_signatures_agree_as_often_as_texts_are_alike(kind):
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 60, dtype=np.uint64)
    one = {"set": np.ones(60), "counts": rng.integers(1, 5, 60).astype(float), "reals": rng.uniform(0.1, 4, 60)}[kind]
    two = one.copy()
    if kind == "set":
        other = np.concatenate([elements[:48], rng.integers(0, 2**63, 12, dtype=np.uint64)])
        want = 48 / 72
    else:
        other, two = elements, one * rng.uniform(0.5, 1.4, 60) if kind == "reals" else rng.integers(1, 5, 60).astype(float)
        want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    got = np.mean([(neardup.signature(elements + np.uint64(i), one, 96) == neardup.signature(other + np.uint64(i), two, 96)).mean() for i in range(40)])
    assert abs(got - want) < 0.04


def test_secret_base_spans_against_brute_force(spark, docs, table):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    planted = ["token=token: abcdef", "API_KEY = 'abc' password:abcdefg", "é AKIA" + "A" * 16 + " AKIAAKIA" + "f" * 24, "a" * 23 + " " + "0" * 24, "secret\"  :  'x.y-z=q'", "ſecret=abcdefgh"]
    extra = spark.createDataFrame([(10_000 + i, t, None, "p") for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").union(extra)
    texts = dict(zip(table.doc_id, table.text, strict=True)) | {10_000 + i: t for i, t in enumerate(planted)}
    got = secrets.scan_documents(both).toPandas()
    assert len(got) == len(texts)
    for x in got.itertuples():
        t = texts[x.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6 and m[0][0] != "ſ"]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_ownership_tells_examples_from_live_keys(spark):
    example, live = "ghp_" + "Example1" * 5, "ghp_" + "Live7Key" * 5
    rows = [(i, f"see {example} here", f"owner{i}") for i in range(4)] + [(9, f"use {live}", "owner0"), (10, f"also {live}", "owner0")]
    got = {r["doc_id"]: r for r in secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["spans"] == "" and got[i]["n_copied"] == 1 for i in range(4))
    assert got[9]["spans"] == "prefixed:4:48" and got[10]["n_live"] == 1


def test_ownership_counts_repositories_and_owners(spark):
    """Two owners are few, unless they have a value in many repositories; a shared repository counts once."""
    few, spread, own = ("ghp_" + x * 5 for x in ("Few2Owns", "Spread2s", "Own3Many"))
    rows = [(f"r{i % 2}", f"x {few}", f"o{i % 2}") for i in range(20)] + [(f"s{i}", f"x {spread}", f"o{i % 2}") for i in range(8)]
    rows += [(f"t{i}", f"x {own}", "o9") for i in range(30)] + [("shared", f"x {few}", "o0"), ("shared", f"x {few}", "o1")]
    df = spark.createDataFrame([(i, r, t, o) for i, (r, t, o) in enumerate(rows)], "doc_id long, repo string, text string, source string")
    got = {r["doc_id"]: r["n_live"] for r in secrets.scan_documents(df, "repo").collect()}
    assert [got[0], got[20], got[28], got[58]] == [1, 0, 1, 1]
    counts = secrets.ownership(df.select(F.col("text").alias("value"), F.col("repo").alias("repository"), F.col("source").alias("owner")))
    assert {(r["repositories"], r["owners"]) for r in counts.collect()} == {(3, 2), (8, 2), (30, 1)}


def test_secrets_in_long_tokens_and_many_matches(spark):
    late = "x" * 55 + "7" + "B" * 10
    many = " ".join(f"{i:024x}" for i in range(30_000)) + " " + " ".join(f"Ab{i:030d}" for i in range(20_000))
    df = spark.createDataFrame([(1, f"x {late} y", "s"), (2, many, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan_documents(df).collect()}
    assert got[1]["spans"] == "mixed:2:68"
    spans = got[2]["spans"].split(",")
    assert got[2]["n_hex"] == 50_000 and spans[1] == "hex:25:49" and len(spans) == 50_000


def test_pii_of_many_matches_in_order():
    text = " ".join(f"user{i}@mail.example.com 2024-01-{i % 28 + 1:02d}" for i in range(25_000))
    spans = pii.Pseudonyms(b"k").spans(text)
    assert len(spans) == 50_000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_packing_places_every_piece_once(docs, table):
    from tokenizers import Tokenizer

    got = packing.pack(docs, queries.vocabulary()).toPandas()
    bound = -(-got.length.sum() // 1024)
    assert bound <= got.sequence_id.nunique() <= 1.02 * bound + 1
    got = got.sort_values(["sequence_id", "offset"])
    each = got.groupby("sequence_id")
    assert (got.offset == each.length.cumsum() - got.length).all() and each.length.sum().max() <= 1024
    coder = Tokenizer.from_file(queries.vocabulary())
    pieces = dict(list(got.sort_values("piece").groupby("doc_id")))
    for i, e in zip(table.doc_id, coder.encode_batch(list(table.text), add_special_tokens=False), strict=True):
        ids, at = np.array([*e.ids, 2], dtype="<u4"), 0
        for x in pieces[i].itertuples():
            assert x.start == at and (x.piece == 0 or x.length == 1024) and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)


def test_crossover_keeps_the_pieces(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    lengths = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 60), rng.integers(1, 30, 60), strict=True)}
    a, b = (packing._started(lengths, 100, rng, kind) for kind in (1, 2))
    for child in (packing.crossover(a, b, 100, 0.99, rng) for _ in range(10)):
        held = Counter()
        for p, n in child.items():
            assert sum(p) <= 100
            for k in p:
                held[k] += n
        assert dict(held) == lengths
    best = packing.evolve(spark, lengths, 100)
    assert sum(best.values()) <= min(sum(a.values()), sum(b.values()))


def test_evolving_beats_the_best_fit(spark):
    lengths = Counter(np.random.default_rng(6).integers(200, 701, 1500).tolist())
    best = packing.evolve(spark, dict(lengths), 1024)
    bound = -(-sum(k * n for k, n in lengths.items()) // 1024)
    assert bound <= sum(best.values()) <= bound + 6 < sum(packing.best_fit(Counter(), lengths, 1024).values()) - 5


def test_runs_give_each_number_its_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 4)
    packed = Counter({(50, 50): 7, (50, 30, 20): 5, (30, 30, 30): 2})
    numbers = [(length, i) for length, n in ((50, 19), (30, 11), (20, 5)) for i in range(n)]
    table = spark.createDataFrame(packing.runs(packed))
    got = packing.placed(spark.createDataFrame(numbers, "length long, number long"), table).toPandas().sort_values(["sequence_id", "offset"])
    each = got.groupby("sequence_id")
    assert (got.offset == each.length.cumsum() - got.length).all()
    assert Counter(tuple(sorted(x, reverse=True)) for x in each.length.apply(list)) == packed


def test_quality_counts_against_brute_force(spark, docs, table):
    planted = ["a b c d e f g h " * 3, "x\n\nx\n \ny\nx", "\x0b\x0c\r", "# * $ %&|<> é", "one two three four five six seven eight nine one two three four five six seven eight"]
    extra = spark.createDataFrame([(10_000 + i, t, "en", "p") for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string")
    texts = dict(zip(table.doc_id, table.text, strict=True)) | {10_000 + i: t for i, t in enumerate(planted)}
    got = quality.judged_documents(docs.select("doc_id", "text", "lang", "source").union(extra)).toPandas()
    assert len(got) == len(texts)
    for x in got.itertuples():
        t = texts[x.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts, covered = Counter(runs), set()
        for i, r in enumerate(runs):
            if counts[r] > 1:
                covered.update(range(i, i + 8))
        lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (x.base_failed and x.kept)


def test_outliers_do_not_hide_each_other(spark):
    """A fifth of a group is junk of one kind; the estimate still rejects it and keeps the rest."""
    rng, rows = random.Random(4), []
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lan", "der", "vi") for c in ("", "n", "sto")]
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(40, 400)))
        rows.append((i, " ".join(w + "###" for w in text.split()) if i % 5 == 0 else text, "en", "hot"))
    got = quality.judged_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert all(x.kept == (x.doc_id % 5 != 0) for x in got.itertuples())


@pytest.mark.parametrize("share", [0.26, 0.34, 0.45])
def test_copies_of_junk_do_not_hide_themselves(spark, share):
    """Copies of one junk text hold up to nearly half of a group, and all have one distance."""
    rng, rows = random.Random(9), []
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lan", "der", "vi") for c in ("", "n", "sto")]
    junk = " ".join(rng.choice(words) + "###" for _ in range(90))
    for i in range(900):
        rows.append((i, junk if i < 900 * share else " ".join(rng.choice(words) for _ in range(rng.randrange(40, 400))), "en", "hot"))
    got = quality.judged_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert not got[got.doc_id < 900 * share].kept.any()
    assert got[got.doc_id >= 900 * share].kept.mean() > 0.99


def test_estimates_against_brute_force(spark):
    """The least determinant found is that of many random starts, and so are the verdicts."""
    rng = np.random.default_rng(8)
    names, floors = list(quality.VECTOR), np.array(list(quality.VECTOR.values()))
    good = rng.normal(size=(280, 5)) @ np.diag([0.4, 0.2, 0.15, 0.3, 0.3]) @ (np.eye(5) + 0.3 * np.tri(5, k=-1))
    x = np.vstack([good, rng.normal(size=(120, 5)) * 0.1 + np.array([2.5, 1.5, 1.0, 2.0, 2.0])])
    df = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, " + ", ".join(f"{n} double" for n in names))
    got = quality.minimum_covariance(df).first()

    def steps(chosen):
        for _ in range(60):
            mean, cov = x[chosen].mean(0), np.cov(x[chosen].T, bias=True) * quality.CONSISTENCY + np.diag(floors**2)
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            chosen = np.argsort(d2, kind="stable")[: len(x) // 2]
        mean, cov = x[chosen].mean(0), np.cov(x[chosen].T, bias=True) * quality.CONSISTENCY + np.diag(floors**2)
        return np.linalg.slogdet(cov)[1], mean, cov

    best = min((steps(rng.choice(len(x), 12, replace=False)) for _ in range(60)), key=lambda b: b[0])
    assert got["log_det"] <= best[0] + 0.05
    mean = np.array([got[f"m_{i}"] for i in range(5)])
    cov = np.array([[got[f"c_{min(i, j)}_{max(i, j)}"] for j in range(5)] for i in range(5)]) + np.diag(floors**2)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    mine, theirs = far(mean, cov), far(best[1], best[2])
    assert ((mine > quality.CUTOFF) == (theirs > quality.CUTOFF)).mean() > 0.99 and (mine[280:] > quality.CUTOFF).all() and (mine[:280] <= quality.CUTOFF).mean() > 0.97


def test_quality_takes_columns_of_any_name(spark):
    names = "n_words kept distance cell symbols n scale row outer_ start".split()
    rows = [(i, f"some words in a text number {i} that has enough of them to be judged as good or bad by all rules", "en", "s", *["7"] * len(names)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    got = quality.verdicts(df, keep=df.columns).filter("kept").select("row.*")
    assert got.columns == df.columns and got.filter("scale <> '7'").isEmpty() and got.count() == 40
    assert quality.judge(df, keep=["doc_id", "n_words", "cell"]).columns == ["doc_id", "cell", *quality.COUNTS, "distance", "kept"]


def test_bpe_is_that_of_the_library(docs, table):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(queries.vocabulary()), bpe.encoder(queries.vocabulary())
    rng = random.Random(6)
    letters = "ab et'sréß9 \n\t|#!?中😀\x85\xa0\x1c ,.-_12ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a   b", "<|endoftext|> a<|endoftext|>", "don't  we'll", "aaaa" * 50, " " * 30 + "x", "antidisestablishmentarianism" * 9, *table.text]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t).tolist() == e.ids
        assert own.decode(own.encode(t)) == library.decode(e.ids, skip_special_tokens=False)
    letters = random.Random(3)
    for t in ("".join(letters.choices("etaoinshrdlucm", k=1_000_000)), "a" * 400_000, " " * 400_000):
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and own.decode(ids) == t
    got = bpe.round_trips(docs, queries.vocabulary()).toPandas()
    text = dict(zip(table.doc_id, table.text, strict=True))
    assert all(x.decoded_sha256 == hashlib.sha256(text[x.doc_id].encode()).hexdigest() for x in got.itertuples())


VALUES = {
    "email": ["ann.lee42@mail8.example.com"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ip": ["55.63.178.142"],
    "card": ["4111 1111 1111 1111", "4845168114407329"],
    "date": ["2024-02-29", "31.12.2001", "03/14/1999"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (988) 555-2485", "(017) 555-0000", "415-555-2671"],
}


def test_pseudonyms_keep_their_format_and_link():
    for kind in pii.KINDS:
        for value in VALUES[kind.name]:
            got = kind.permute(b"key", value)
            assert kind.valid(got) and got != value and kind.permute(b"key", got, back=True) == value
            assert re.sub(r"\w", "", got) == re.sub(r"\w", "", value)
            assert kind.permute(b"other", value) != got


def test_feistel_is_a_permutation():
    for radices in ([10, 10, 10], [26], [10, 26], [2, 3, 4, 5]):
        every = np.array(np.meshgrid(*[range(r) for r in radices])).reshape(len(radices), -1).T.tolist()
        assert len({tuple(pii.feistel(b"k", "t", x, radices)) for x in every}) == len(every)


def test_only_validated_values_are_replaced(spark):
    text = f"Mail {VALUES['email'][0]}, card {VALUES['card'][1]}, not a card 4845168114407328, version 1.2.3, call {VALUES['phone'][0]} twice {VALUES['phone'][0]}."
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, VALUES["email"][0], 5)], "doc_id long, text string, pii_email int")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, b"key").collect()}
    out = got[1]["text"]
    assert "4845168114407328" in out and "version 1.2.3" in out and VALUES["card"][1] not in out
    assert got[3]["text"] in out and out.count(re.search(r"call (\S+ \S+ \S+) twice", out)[1]) == 2
    assert (got[1]["pii_email"], got[1]["pii_phone"], got[2]["text"], got[2]["pii_email"]) == (1, 2, None, 0)


def test_pipeline_stages_take_effect(spark, table):
    import corpus_pipeline as p

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = spark.createDataFrame([(10**6, "12345 678", "en", "src0", 9), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.union(extra)
    for _, step in p.STAGES[:-1]:
        before, docs = docs, p.stage(step(spark, docs, SF), "test")
        assert docs.columns == before.columns
        sizes.append(docs.count())
    assert sizes[0] == len(table) and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    kept = docs.toPandas()
    classes = brute_classes(list(kept.doc_id), list(kept.text))
    assert len(set(classes.values())) == len(kept)
    packed = p.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(kept.doc_id)


def test_language_stage_fills_in_and_keeps_columns(spark):
    import corpus_pipeline

    rows = [(i, f"the cat and the dog number{i}", "en" if i % 2 else None, "s", 10, 7.0, "x") for i in range(20)]
    rows += [(98, None, "en", "s", 0, 7.0, "x"), (99, "12 34", "en", "s", 5, 7.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    got = corpus_pipeline.language_id(spark, df, SF)
    assert got.columns == df.columns
    assert {tuple(r)[2:] for r in got.collect()} == {("en", "s", 10, 7.0, "x")} and got.count() == 20
    assert corpus_pipeline.language_id(spark, df.limit(0), SF).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == 20


def test_rare_languages_are_kept_and_stray_ones_are_not(spark):
    """Fourteen texts of a language with words of its own among thousands; one stray label."""
    rng = random.Random(3)
    speak = lambda words: " ".join(rng.choice(words) for _ in range(12))
    en, fr, xx = ["the", "cat", "house", "water", "run"], ["le", "chat", "maison", "eau", "cours"], ["zorb", "quix", "vlek", "jumf", "plyk"]
    rows = [(i, f"{speak(en)} {i}", "en") for i in range(2_000)] + [(5_000 + i, f"{speak(fr)} {i}", "fr") for i in range(1_000)]
    rows += [(9_000 + i, f"{speak(xx)} {i}", "xx") for i in range(14)] + [(9_900, "stray", "zz")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.langs == ["en", "fr", "xx"]
    told = {r["doc_id"]: (r["lang"], r["p"]) for r in language.identify(df, model, "p", "s").filter("doc_id < 9900").collect()}
    assert all(lang == p for lang, p in told.values())
    assert language.train(df, language.Limits(langs=1)).langs == ["en"]


def test_predictions_are_those_of_a_plain_backoff(docs, table):
    """Scores by dictionaries: known words, else the longest known n-grams' mean, with half a unit off for each shorter length."""
    model = language.train(docs.filter(~language.held_out()))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    scores = {w: model.word_scores[i] for w, i in model.words.items()}
    for doc, text in table[["doc_id", "text"]].itertuples(index=False):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            assert got[doc] == ("und", 0.0)
            continue
        total = np.zeros(len(model.langs))
        for w in words:
            if w in scores:
                total += scores[w]
                continue
            for k in range(4, 0, -1):
                p = f"<{w}>"
                found = [model.gram_scores[k - 1][model.grams[k - 1][g]] for g in (p[i : i + k] for i in range(len(p) - k + 1)) if g in model.grams[k - 1]]
                if found:
                    total += np.mean(found, axis=0) - 0.5 * (4 - k)
                    break
        mean = total / len(words)
        likely = np.exp(mean - mean.max())
        assert got[doc][0] == model.langs[int(likely.argmax())] and abs(got[doc][1] - likely.max() / likely.sum()) < 1e-9


def test_iban_check_digits_are_told_apart():
    """All valid numbers of one account: pseudonyms differ and lead back."""
    given = [f"GB{c:02d}WEST1234569876543{d}" for c in range(100) for d in range(10)]
    valid = [v for v in given if pii._iban_valid(v)]
    made = {v: pii._iban(b"key", v) for v in valid}
    assert len(set(made.values())) == len(valid) and all(pii._iban_valid(m) for m in made.values())
    assert all(pii._iban(b"key", m, back=True) == v for v, m in made.items())
    assert not any(v[2:4] in ("00", "01", "99") for v in valid)


def test_shards_keep_columns_of_any_name_and_their_order_is_plain(spark):
    names = ["order", "before_", "bucket", "row", "a.b"]
    rows = [(i, f"text {i}" if i % 7 else None, *[i * 10 + j for j in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = sharding.external_shuffle(df, 8, bucket_bytes=700)
    assert sorted(got.columns) == sorted(["doc_id", "text", *names, "shard", "slot"])
    kept = sorted(tuple(r)[:7] for r in got.collect())
    assert kept == rows
    # Brute force: buckets by hash, rows in hash order, Fisher-Yates by bucket, dealt out in turn.
    hashed = df.select("doc_id", "text", F.xxhash64(F.lit(42), "doc_id", "text").alias("h"), F.xxhash64(F.lit(43), "doc_id", "text").alias("o")).collect()
    buckets = max(1, -(-sum(len((r["text"] or "").encode()) + 1 for r in hashed) // 700))
    at, want = 0, {}
    for b in range(buckets):
        own = sorted((r for r in hashed if r["h"] % buckets == b), key=lambda r: r["o"])
        for i in np.random.Generator(np.random.PCG64([42, b])).permutation(len(own)):
            want[own[i]["doc_id"]] = (at % 8, at // 8)
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got.collect()} == want


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["language_pred__", "score", "pred", "row", "hash", "nth__", "doc__", "text_hash__", "order"]
    texts = [f"{PROSE} number {i // 2} of the herd went over the hill and the river" for i in range(40)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t), *[i] * len(names)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name in ("language_id", "near_duplicates", "pii"):
        got = dict(corpus_pipeline.STAGES)[name](spark, df, SF)
        assert got.columns == df.columns
        assert all(tuple(r)[5:] == (r["doc_id"],) * len(names) for r in got.collect())


def test_pipeline_of_an_empty_table_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    texts = [f"{PROSE} {' '.join(random.Random(i).choices(PROSE.split(), k=40))}" for i in range(30)]
    spark.createDataFrame([(None if i % 3 == 0 else i, t, "en", None, None) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() > 0
