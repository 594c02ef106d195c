"""Spelling variants, phrase mining and exact top-k search against brute force,
SQL and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import phrases, spelling, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, word string, bit long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *columns):
    text = lambda v: (v is not None, v)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [text(v) for v in r])


# --- spelling variants -------------------------------------------------------

COLUMNS = "word form root n n_near form_n".split()


def plain_variants(table, least=3):
    counts = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if k >= least and len(w) >= 5}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for w in n:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    forms = {w: min(near[w], key=lambda u: (-n[u], u)) for w in n if near[w]}
    forms = {w: f for w, f in forms.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n[w], len(near[w]), n[forms[w]] if w in forms else None))
    return sorted(out)


def test_variants_against_brute_force(docs):
    got = sorted(map(tuple, spelling.variants(docs).select(*COLUMNS).collect()))
    assert got == plain_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] and r[1] != r[2] for r in got)


def test_variants_in_small_passes_with_crowded_filters(spark, docs):
    """Many passes and filters that are nearly full: all false positives go in the join."""
    want = sorted(map(tuple, spelling.variants(docs).select(*COLUMNS).collect()))
    got = spelling.variants(docs, spelling.Sizes(words=700, bits=3)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == want


def test_every_kind_of_edit_and_odd_rows(spark):
    long = "q" * 70_000
    texts = ["hello " * 9, "hallo " * 4, "helloo " * 3, "ello hell", "Hélloé " * 3, "héllo " * 3, "aabbc aabbc aabbc abbc aabc " * 3, f"{long} " * 3, f"{long}q " * 3, None, "", "é ÿÿÿÿÿĀÿÿÿÿÿ ÿÿÿÿÿ", "HELLO"]
    table = [(i, t, "en", 1, "w", 2) for i, t in enumerate(texts)] + [(None, "hello world world worlds", None, None, None, None)] * 3
    got = spelling.variants(spark.createDataFrame(table, DOCS))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain_variants([r[:2] for r in table])
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


# --- phrases -----------------------------------------------------------------


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_", df.toArrow())
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM {name}_")
    return con


PHRASE = "lang rank phrase a l r n score".split()


def from_sql(docs, sql=phrases.SQL):
    return duck(documents=docs).sql(f"SELECT {', '.join(PHRASE)} FROM ({sql})").fetchall()


@pytest.mark.parametrize("rules", [phrases.Rules(), phrases.Rules(shards=3, bits=16, buffer=500, part=1_000), phrases.Rules(shards=1, bits=6)], ids=["given", "small buffers", "crowded bitmap"])
def test_phrases_against_sql(docs, rules):
    assert rows(phrases.collocations(docs, rules), *PHRASE) == sorted(from_sql(docs))


def test_phrases_begun_late_are_counted_whole(spark):
    """Words that become frequent in the last shard only, phrases in few texts, and nulls."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) + rng.choice([".", "\n", "", "\t", " ;x"]) for _ in range(150)]
    texts += ["late comers win " * 12, "A b! a B, a b: c\x0bd", None, "", "x" * 50_000, "ö ß ß " * 12]
    table = [(i, t, rng.choice(["en", "fr", None]), 1, "w", 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(table + table[:40], DOCS)
    for shards in (1, 2, 5):
        assert rows(phrases.collocations(df, phrases.Rules(shards=shards, bits=18)), *PHRASE) == sorted(from_sql(df))
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_steps_write_no_copy_of_the_texts_and_few_bits_of_a_hash(spark, monkeypatch):
    made, stage = {}, phrases.stage
    monkeypatch.setattr(phrases, "stage", lambda d, name, *by, **how: made.setdefault(name, stage(d, name, *by, **how)))
    df = spark.createDataFrame([(i, "one two three " * 12 + f"w{i} x{i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    counts = phrases.phrase_counts(df, phrases.Rules(bits=16)).filter("n >= 10 and k > 0")
    assert {r["phrase"]: r["n"] for r in counts.collect() if r["k"] == 3} == {"one two three": 2_400, "two three one": 2_200, "three one two": 2_200}
    assert not [name for name, d in made.items() if "text" in d.columns]
    found = [phrases._unpacked(bytes(r["counts"]))[0].max() for name, d in made.items() if "counts" in d.columns for r in d.collect()]
    assert found and max(found) < 1 << 20


def test_what_is_shuffled_is_packed(spark, monkeypatch):
    """A range's counts of all languages of a buffer are one block of few bytes a phrase, and lists come back as they were."""
    made, stage = {}, phrases.stage
    monkeypatch.setattr(phrases, "stage", lambda d, name, *by, **how: made.setdefault(name, stage(d, name, *by, **how)))
    rng = random.Random(3)
    table = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(40)), "de" if i % 2 else "en") for i in range(1_000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1)
    assert phrases.phrase_counts(df).filter("k = 0").agg(F.sum("n")).first()[0] == 40_000
    blocks = [r for name, d in made.items() if "counts" in d.columns for r in d.withColumn("step", F.lit(name)).collect()]
    assert len({(r["step"], r["k"], r["since"], r["part"]) for r in blocks}) == len(blocks)
    pairs = [bytes(r["counts"]) for r in blocks if r["k"] == 2]
    assert sum(map(len, pairs)) < 3 * sum(len(phrases._unpacked(x)[0]) for x in pairs)
    words = sorted({"", "ä", "ß 中", "\u2028 \x85", *(f"the word {i} of" for i in range(3_000))})
    n = np.array([3_000_000_000, *range(1, len(words))])
    packed = phrases._listed(words, n)
    assert phrases._unlisted(packed).to_pydict() == {"phrase": words, "n": n.tolist()}
    assert phrases._unlisted(phrases._listed([""], n[:1])).to_pydict() == {"phrase": [""], "n": [3_000_000_000]}
    assert len(packed) < 8 * len(words)


def test_longer_phrases_drop_those_inside(spark):
    """Phrases of four words: counts, cuts and dropping against a plain version."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(20)) for _ in range(40)] + ["p q r s . q r t . " * 11]
    counts, least = Counter(), 10
    for t in texts:
        for piece in t.split("."):
            w = piece.split()
            for k in range(1, 5):
                counts.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if " " in p and a >= least}
    want = []
    for p, a in candidates.items():
        if any(f" {p} " in f" {q} " and p != q and 100 * b >= 50 * a for q, b in candidates.items()):
            continue
        w = p.split()
        cuts = [(10**6 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        want.append((p, a, counts[" ".join(w[:k])], counts[" ".join(w[k:])], score))
    df = spark.createDataFrame([(i, t, "en", 1, "w", 2) for i, t in enumerate(texts)], DOCS)
    got = phrases.collocations(df, phrases.Rules(longest=4, least=least, bits=18))
    assert rows(got, "phrase", "a", "l", "r", "score") == sorted(want) and "p q r" not in {w[0] for w in want}


# --- exact top-k search ------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id long, norm double, asks boolean, ints string"


def plain_top(table, every=50, k=5):
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in fine)
    fine = [(i, np.concatenate([v, np.zeros(width - len(v), dtype=int)])) for i, v in fine]
    out = []
    for q, v in fine:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_against_sql(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = duck(embeddings=v).sql(f"SELECT query_id, rank, vec_id, score FROM ({topk.SQL})").fetchall()
    assert found(topk.top_embeddings(v)) == sorted(want)


@pytest.mark.parametrize("kind", ["spread lengths", "copies", "low rank"])
def test_top_k_in_small_cells(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 12))
    if kind == "spread lengths":
        v *= rng.lognormal(0, 1.5, size=(900, 1))
    elif kind == "copies":
        v[200:700] = v[3]
    else:
        v = rng.normal(size=(900, 2)) @ rng.normal(size=(2, 12))
    table = [(i, v[i].tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, x, 1, 2.0, True, "s") for i, x in table], VECTORS)
    small = topk.Sizes(block=37, head=50, queries=7, candidates=111)
    assert found(topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, sizes=small)) == plain_top(table)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 2.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (1, [inf, 1.0]), (2, [None, 1.0]), (3, []), (4, [3.0]), (None, [9.0, 9.0]), (5, [-1.0, -1.0]), (200, [1.0, 2.0]), (6, [1e6, -1e6])]
    df = spark.createDataFrame([(i, x, 1, 2.0, True, "s") for i, x in table], VECTORS)
    assert found(topk.top_embeddings(df)) == plain_top(table)
    assert topk.top_embeddings(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.top_embeddings(df.filter("vec_id = 3")).count() == 0
    huge = spark.createDataFrame([(0, [1e17], 1, 2.0, True, "s"), (1, [1e17], 1, 2.0, True, "s")], VECTORS)
    with pytest.raises(Exception, match="passes 64 bits|overflow|Overflow|OVERFLOW"):
        topk.top_embeddings(huge).collect()


def test_pruning_skips_pairs_and_loses_none():
    """Of vectors with falling lengths most pairs are never scored in full."""
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(4_000, 16)) * np.linspace(3, 0.05, 4_000)[:, None]).astype(np.int64)
    turn = np.linalg.eigh((rows.T @ rows).astype(float))[1][:, ::-1].copy()
    search = topk.Search(np.arange(5), rows[:5], turn, np.full(5, -np.inf), 5, 4)
    scored, exact = [], topk._products
    try:
        topk._products = lambda a, b: scored.append(len(a) * len(b)) or exact(a, b)
        for lo in range(0, 4_000, 250):
            search.meet(np.arange(lo, lo + 250), rows[lo : lo + 250])
    finally:
        topk._products = exact
    products = rows[:5] @ rows.T
    for q in range(5):
        want = sorted((-int(s), i) for i, s in enumerate(products[q]) if i != q)[:5]
        own = search.found[0] == q
        assert [(-s, i) for s, i in zip(search.found[1][own].tolist(), search.found[2][own].tolist(), strict=True)] == want
    assert sum(scored) < 0.5 * 5 * 4_000
