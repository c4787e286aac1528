"""Numbering rows in any order without a task that sorts them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in every column, nulls included."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def counted(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the rows in ranges of (keys, order), as a table whose column ``_range`` ascends with them; and rows (_range, keys, _rows, _before, _all): how many rows of a key a range holds, the ranges before it, and all."""
    rows = cut(df.repartitionByRange(*(F.col(f"`{c}`") for c in [*keys, *order])).withColumn("_range", F.spark_partition_id()), "ranges", result=True)
    counts = rows.groupBy("_range", *keys).agg(F.count("*").alias("_rows"))
    every = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range, and one more for each key
    return rows, cut(counts.withColumns({"_before": before, "_all": F.sum("_rows").over(every)}), "counts", result=True)


def numbered(df: DataFrame, keys: list[str], order: list[str], place: str = "place", total: str | None = None) -> DataFrame:
    """Adds each row's ``place`` (from 0) among the rows with its ``keys`` in ascending ``order`` (nulls first), and if asked their number.

    Rows are dealt into ranges of (keys, order) and written; a row is numbered within its range and shifted by what
    the ranges before hold of its key, so a key with any share of the rows is spread over as many tasks. Only rows
    that agree in keys and order meet in one task.
    """
    rows, counts = counted(df, keys, order)
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1)
    found = rows.join(counts, same(rows, counts, ["_range", *keys]))
    added = {place: F.col("_place") + F.col("_before")} | ({total: F.col("_all")} if total else {})
    return found.select(*(rows[c] for c in df.columns), *(c.alias(n) for n, c in added.items()))


def between(df: DataFrame, order: list[str], start: int, end: int | None) -> DataFrame:
    """The rows from place ``start`` up to ``end`` of a total order, in any order: ranges that lie outside aren't read, and only the two that a bound cuts are numbered."""
    rows, counts = counted(df, [], order)
    held = [(r["_range"], r["_before"], r["_rows"]) for r in counts.collect()]  # a row a range
    last = float("inf") if end is None else end
    inside = [i for i, at, n in held if start <= at and at + n <= last]
    edges = [(i, at) for i, at, n in held if at < last and at + n > start and not (start <= at and at + n <= last)]
    out = rows.where(F.col("_range").isin(inside))
    for i, at in edges:
        part = rows.where(F.col("_range") == i).withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + at)
        out = out.unionByName(part.where((F.col("_place") >= start) & ((F.col("_place") < end) if end is not None else F.lit(True))).drop("_place"))
    return out.select(*df.columns)
