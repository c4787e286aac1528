"""A sink of JSON lines or Parquet that holds each batch once, whatever fails in between.

A batch is written to a folder of its own, then a ledger entry named by stream and batch number is put beside the data
in one step; what has no entry doesn't count. A batch that runs again because its stream was killed finds its entry and
writes nothing, or finds none and is written to a new folder. The ledger goes by the id that a stream keeps in its
checkpoint, so several streams may share a sink.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.lineage import drop
from millrace.sources import io


class Ledger:
    def __init__(self, spark: SparkSession, path: str, form: str = "json"):
        self.spark, self.path, self.form = spark, path.rstrip("/"), form
        for part in ("data", "ledger"):
            io.ensure_folder(spark, f"{self.path}/{part}")

    def has(self, key: str) -> bool:
        return io.exists(self.spark, f"{self.path}/ledger/{key}.json")

    def commit(self, key: str, folder: str) -> bool:
        return io.put(self.spark, json.dumps({"key": key, "folder": folder}), f"{self.path}/ledger/{key}.json")

    def append(self, rows: DataFrame, key: str) -> bool:
        """Adds the rows as batch ``key``; False where the ledger has it already."""
        if self.has(key):
            return False
        folder = f"{key}-{uuid.uuid4().hex}"
        rows.write.format(self.form).save(f"{self.path}/data/{folder}")
        return self.commit(key, folder)

    def folders(self) -> list[str]:
        """Of all committed batches."""
        if not [n for n in io.names(self.spark, f"{self.path}/ledger") if n.endswith(".json")]:
            return []
        entries = self.spark.read.schema("key string, folder string").json(f"{self.path}/ledger/*.json").collect()  # a row a batch
        return sorted(f"{self.path}/data/{e['folder']}" for e in entries)

    def read(self, schema) -> DataFrame:
        """The rows of all committed batches."""
        found = self.folders()
        return self.spark.read.schema(schema).format(self.form).load(found) if found else self.spark.createDataFrame([], schema)

    def sweep(self) -> int:
        """Deletes what failed batches left; how many folders there were. Only while no stream writes."""
        left = set(f"{self.path}/data/{n}" for n in io.names(self.spark, f"{self.path}/data")) - set(self.folders())
        for folder in left:
            drop(self.spark, folder)
        return len(left)


def stream_id(spark: SparkSession) -> str:
    """Within a batch function: the id that the running stream keeps in its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def run(source: DataFrame, each: Callable[[DataFrame, str], None], checkpoint: str) -> None:
    """Runs ``each`` (rows, key) on every batch of a bounded stream until none is left; the key names stream and batch."""

    def batch(rows: DataFrame, number: int) -> None:
        each(rows, f"{stream_id(rows.sparkSession)}-{number:09d}")

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drain(source: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> Ledger:
    """Takes every batch of a bounded stream through ``step`` to the sink ``out``."""
    sink = Ledger(source.sparkSession, out)
    run(source, lambda rows, key: sink.append(step(rows) if step else rows, key) and None, checkpoint)
    return sink
