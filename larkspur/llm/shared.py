"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset and Spark
    runs on this machine alone, as in tests, a temporary folder of this
    application's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")
    return _own[app]


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders by a column or not, and read it back.

    This cuts the lineage: what follows rereads files that outlive any
    executor, and rows, ids and sampled bounds no longer change on a retry.
    """
    path = f"{shared_dir(df.sparkSession)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text() -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


#: A key with more than this part of all rows is dealt over several tasks.
HOT_PART = 1000


def dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique, without hot keys.

    A key that has more than a thousandth of the rows, of which there are at
    most a thousand, has its row of ``table`` repeated, and its rows are dealt
    over these copies by a hash of ``by``. Only that list of keys is broadcast.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    hot = counts.filter(F.col("n_") * HOT_PART > total).select(key, F.ceil(F.col("n_") * HOT_PART / F.lit(max(total, 1))).cast("int").alias("salts_"))
    hot = F.broadcast(stage(hot.repartition(1), "hot"))
    salts = F.coalesce("salts_", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts_")
    right = table.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts_")
    return left.join(right, [key, "salt_"]).drop("salt_")
