"""Bounded streams: files in, filtered and cut texts out, each input file once (the checkpoint remembers them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def prepared(df: DataFrame, tokens: int = 4000) -> DataFrame:
    """Rows (doc_id, prompt) with a prompt: at most ``tokens`` white-space tokens of the text."""
    return df.select("doc_id", X.first_tokens(F.col("text"), tokens).alias("prompt")).where("prompt <> ''")


def ingest(source: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the stream over what is there now and stops."""
    query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(df: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Exact duplicates within the watermark dropped; the state holds the keys of that time only."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(df: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
