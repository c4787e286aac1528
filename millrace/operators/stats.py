"""Grouped statistics in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Rows (key, value, n, ...): totals overall (key ``total``) and by each of ``keys`` alone, as grouping sets of one aggregation."""
    sets = [[], *([F.col(k)] for k in keys)]
    grouped = df.groupingSets(sets, *(F.col(k) for k in keys)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), *(c.alias(k) for k, c in more.items()))
    everything = 2 ** len(keys) - 1
    name, value = F.when(F.col("gid") == everything, "total"), F.when(F.col("gid") == everything, "")
    for i, k in enumerate(keys):
        mine = everything - 2 ** (len(keys) - 1 - i)
        name = name.when(F.col("gid") == mine, k)
        value = value.when(F.col("gid") == mine, F.col(k).cast("string"))
    return grouped.select(name.alias("key"), value.alias("value"), "n", *more)
