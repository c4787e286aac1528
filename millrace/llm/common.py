"""What the operators of this subpackage share: reading tables, cutting lineage, the held-out rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import cut, release, scratch, shared_dir
from millrace.session import ship

__all__ = ["columns", "cut", "is_held_out", "ready", "release", "scratch", "shared_dir", "table", "tidy"]

BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Makes the session fit for whole texts: workers can import the package, and an Arrow batch holds at most BATCH_ROWS rows, as both the JVM and the worker hold a batch whole. The option stays set: results are lazy, and read it when they run."""
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back to the system after its partition: workers outlive many tasks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded frame of numbers; it reaches the driver in Arrow batches, not as rows."""
    found = df.toArrow()
    return [found.column(i).to_numpy() for i in range(found.num_columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
