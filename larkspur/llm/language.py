"""Language identification by word-first backoff.

Training counts, with Spark, the words of each language and the character
n-grams of its distinct words. A document's words that the model knows score
by their log frequency in each language; an unseen word falls back to its
n-grams, from the longest length of which any is known down to single
characters. The language with the highest sum wins; the score is its share
after a softmax of the mean log likelihoods per word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, and numbers that are no digits (as ² and Ⅷ).
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Limits:
    """Documented bounds of the model.

    Of each language an equal part of ``docs`` distinct labelled texts is
    learned from, ``least_each`` at least, or all where there are fewer: those
    with the smallest seeded hashes, each once and whole; all their words and
    n-grams are kept. So the model, which is what goes to executors, does not
    grow with the corpus: it knows at most ``langs`` languages, those with the
    most texts (ties by name). A language needs ``least_texts`` distinct texts,
    however large the corpus is, so that a stray value of ``lang`` adds none.
    """

    docs: int = 1_000
    longest: int = 4
    langs: int = 200
    least_texts: int = 5
    least_each: int = 50


@dataclass(frozen=True)
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    word_scores: np.ndarray
    gram_scores: list[np.ndarray]


def train(labelled: DataFrame, limits: Limits = Limits()) -> Model:
    """Learn from ``text`` and ``lang`` of rows where both are set.

    Repeated rows count once; of an empty table, or one without labels, a model
    of no language is learned. Other columns are not read.
    """
    labelled = labelled.select("text", "lang").filter("text is not null and lang is not null")
    labelled = labelled.select("text", "lang", F.xxhash64(F.lit(7), "lang", "text").alias("h"))
    # Copies count once, so that one text with a third of all rows keeps the bound.
    texts = labelled.select("lang", "h").distinct().groupBy("lang").count().filter(F.col("count") >= limits.least_texts)
    known = dict(texts.orderBy(F.desc("count"), "lang").limit(limits.langs).collect())
    langs = sorted(known)
    # A bounded sample by hash: of a language with more texts, four standard deviations below the bound.
    each = max(limits.least_each, limits.docs // max(1, len(langs)))
    cut = F.lit(None).cast("long")
    for lang, n in known.items():
        most = -(2**63) + int(max(1.0, each - 4 * math.sqrt(each)) / n * 2**64) if n > each else 2**63 - 1
        cut = F.when(F.col("lang") == lang, F.lit(most)).otherwise(cut)
    labelled = labelled.filter(F.col("h") <= cut).dropDuplicates(["h"])
    word = F.explode(F.expr(r"filter(split(lower(text), '[^\\p{L}]+'), w -> w != '')")).alias("word")
    counts = labelled.select("lang", word).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.persist()
    at = {x: i for i, x in enumerate(langs)}

    def table(df: DataFrame, key: str) -> tuple[dict[str, int], np.ndarray]:
        by = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        rows = by.orderBy(key).collect()
        found = np.zeros((len(rows), len(langs)))
        for i, r in enumerate(rows):
            for lang, k in r["by"].items():
                found[i, at[lang]] = k
        total = found.sum(axis=0) + 0.5 * (len(rows) + 1)
        return {r[key]: i for i, r in enumerate(rows)}, np.log((found + 0.5) / total) if rows else found

    words, word_scores = table(counts, "word")
    grams, gram_scores = [], []
    for k in range(1, limits.longest + 1):
        cut = F.expr(f"transform(sequence(1, length(p) - {k - 1}), i -> substring(p, i, {k}))")
        padded = counts.select("lang", "n", F.concat(F.lit("<"), "word", F.lit(">")).alias("p")).filter(F.length("p") >= k)
        of = padded.select("lang", "n", F.explode(cut).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        known, scores = table(of, "gram")
        grams.append(known)
        gram_scores.append(scores)
    counts.unpersist()
    return Model(langs, words, grams, word_scores, gram_scores)


def words_of(text: str) -> list[str]:
    """Runs of letters (general category L) in lower case; anything else ends a word."""
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [p for w in words for p in "".join(c if c.isalpha() else " " for c in w).split()]


class Scorer:
    """Rows of scores by word; unseen words are worked out once and kept, up to a bound."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.at = dict(self.model.words)
        self.rows = np.zeros((len(self.at) + 65_536, max(1, len(self.model.langs))))
        if self.at:
            self.rows[: len(self.at)] = self.model.word_scores
        self.n = len(self.at)

    def backoff(self, word: str) -> np.ndarray:
        padded = f"<{word}>"
        for k in range(len(self.model.grams), 0, -1):
            known = self.model.grams[k - 1]
            found = [known[g] for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) in known]
            if found:
                return self.model.gram_scores[k - 1][found].mean(axis=0) - 0.5 * (len(self.model.grams) - k)
        return np.zeros(self.rows.shape[1])

    def index(self, words: list[str]) -> np.ndarray:
        found = list(map(self.at.get, words))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    if (j := self.at.get(w)) is None:
                        if self.n == len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        j = self.at[w] = self.n
                        self.rows[j] = self.backoff(w)
                        self.n += 1
                    found[i] = j
        return np.array(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if self.n > len(self.model.words) + self.most:
            self.reset()
        at = self.index(words)  # may replace the rows
        mean = self.rows[at].mean(axis=0)
        likely = np.exp(mean - mean.max())
        best = int(likely.argmax())
        return self.model.langs[best], float(likely[best] / likely.sum())


def identify(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all rows of ``docs``, by their whole texts.

    A null text or one without letters is ``und`` with score 0, as is any text
    if nothing could be learned; ties go to the first language by name. Columns
    of the two names, which can be chosen, are replaced; others are kept.
    Repeated rows get equal predictions; an empty table gives no rows.
    """
    docs = docs.drop(lang_pred, score)
    schema = docs.withColumn(lang_pred, F.lit("")).withColumn(score, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def predicted(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, lang_pred, score],
            )

    return docs.mapInArrow(predicted, schema)


def held_out() -> F.col:
    """Documents never learned from: crc32 of the id as text, modulo 3, is 1 (a null id counts as the text 'null')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def identified_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Train on the documents that are not held out, then predict every one."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()), limits)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
