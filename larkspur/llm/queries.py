"""The queries of this folder, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, language, neardup, packing, phrases, pii, quality, revisits, secrets, sharding, spelling, topk
from .shared import documents


def vocabulary() -> str:
    """The tokenizer file that the queries are given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: the session's ``spark.larkspur.pii.key``. Only
    the public test tables may go without it, by a key that anyone can read here."""
    return spark.conf.get("spark.larkspur.pii.key", "public-test-tables").encode()


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return fingerprints.fingerprint_edits(documents(spark, sf_dir)).select(columns)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified_documents(documents(spark, sf_dir))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolved_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged_documents(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(documents(spark, sf_dir), vocabulary())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_fingerprints, op2_sharding, op3_language, op4_revisits, op5_near_duplicates, op6_secrets, op7_packing, op8_quality, op9_bpe, op10_pii, op11_spelling, op12_phrases, op13_topk]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_revisits": revisits.SQL, "op12_phrases": phrases.SQL, "op13_topk": topk.SQL}
