"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_results: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset and all run in one process (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, hint: str = "t", result: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps restart from the files when executors are lost. Within ``scratch()`` only a ``result`` outlives the block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_results if result else _written).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, hint: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/millrace-{hint}-{uuid.uuid4().hex}"
    _results.append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what was cut inside."""
    mark = len(_written)
    try:
        yield
    finally:
        while len(_written) > mark:
            drop(*_written.pop())


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete every table that ``cut`` wrote. Call it only when no result that reads them is still to be computed."""
    for tables in (_written, _results):
        while tables:
            try:
                drop(*tables.pop())
            except Exception:  # at exit the session may be gone
                return


atexit.register(release)
