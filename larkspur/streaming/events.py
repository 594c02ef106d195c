"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import shared_folder


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a file stream; its schema is that of the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user, closed once the watermark has passed their end."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _drain(stream_df: DataFrame, top: str) -> None:
    """Append what a stream gives of what is there now to ``top``/out; offsets and state are in ``top``/state."""
    sink = stream_df.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drained(stream_df: DataFrame) -> DataFrame:
    """Run a stream over what is there, into files, and read them back."""
    spark, top = stream_df.sparkSession, _folder(stream_df.sparkSession)
    _drain(stream_df, top)
    return spark.read.schema(stream_df.schema).parquet(f"{top}/out")


def drained_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The sessions of all events that are there, the last ones too.

    Appended sessions end with the watermark. When all events are read, one
    event of nobody, far ahead, moves it past all ends; its own session stays
    open, so it is never given out.
    """
    spark, top = events.sparkSession, _folder(events.sparkSession)
    ahead = f"{top}/ahead"
    spark.createDataFrame([], events.schema).write.parquet(ahead)
    found = sessions(events.unionByName(spark.readStream.schema(events.schema).parquet(ahead)), gap, late)
    _drain(found, top)
    nobody = [F.lit("9000-01-01").cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(nobody).write.mode("append").parquet(ahead)
    _drain(found, top)
    return spark.read.schema(found.schema).parquet(f"{top}/out")
