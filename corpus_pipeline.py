"""A corpus pipeline: language ID, quality rules, near-duplicates, PII, packing.

Each stage takes all that its predecessor kept; all but the last return the
columns of documents, further ones too whatever their names. Null and empty
texts go with the first stage, as they have no language; repeated rows count as
near copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import language, neardup, packing, pii, quality
from larkspur.llm.queries import pii_key, vocabulary
from larkspur.llm.shared import documents, stage


#: Share of the way from chance to certainty below which a language is no better than a guess.
GUESS = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; it fills in where ``lang`` is null.

    Texts without letters go, and those that the model's languages fit all
    alike: a score (the best one's share) within a twentieth of the way from
    chance to 1. The model learns from the labelled documents that are not held
    out; if there is nothing to learn from, all texts with letters stay.
    """
    model = language.train(docs.filter(~language.held_out()))
    told = language.identify(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), model, "pred", "score")
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    chance = 1 / len(model.langs)
    sure = (F.col("pred") != language.UNKNOWN) & (F.col("score") >= chance + GUESS * (1 - chance))
    of = lambda c: F.coalesce(F.col("row.lang"), F.col("pred")) if c == "lang" else F.col("row").getField(c)
    return told.filter(sure).select(*[of(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.verdicts(docs, keep=docs.columns).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return neardup.first_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses replaced under the session's key."""
    return pii.pseudonymize(docs, pii_key(spark), counts=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", pseudonyms),
    ("packing", best_fit_packing),
]

#: SQL can express none of the model-based stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
