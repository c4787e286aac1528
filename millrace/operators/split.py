"""Stratified splits by quotas, and halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import stablerand as R


def placed(df: DataFrame, keys: list[str], order: str, place: str = "rn", total: str | None = None, lanes: int = 64) -> DataFrame:
    """Adds each row's place (from 1) in its stratum, in ``order``, a column of hex digits, and if asked the stratum's size.

    A row is numbered within a lane (a leading range of the hashed order) and shifted by the counts of the lanes
    before, so no task sorts a whole stratum, however large.
    """
    lane = F.floor(F.conv(F.substring(order, 1, 4), 16, 10).cast("long") * lanes / 65536).cast("int")
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys)) if keys else F.lit("")
    rows = df.withColumn("_key", key).withColumn("_lane", lane)
    counts = rows.groupBy("_key", "_lane").agg(F.count("*").alias("_c"))
    every = Window.partitionBy("_key")
    before = every.orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_key", "_lane", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"), F.sum("_c").over(every).alias("_all"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_lane").orderBy(order))).join(shift, ["_key", "_lane"])
    rows = rows.withColumn(place, F.col("_rn") + F.col("_shift"))
    if total is not None:
        rows = rows.withColumn(total, F.col("_all"))
    return rows.drop("_key", "_lane", "_rn", "_shift", "_all")


def ranges(df: DataFrame, key: str, order: str, ends: list[int], out: str = "bucket") -> DataFrame:
    """Numbers rows by stratum and cuts at ``ends``: bucket 1 up to the first end, ..., the rest in the last. Undersized strata fill what they can."""
    rn = placed(df, [key], order)
    bucket = F.lit(1)
    for e in ends:
        bucket = bucket + (F.col("rn") > e).cast("int")
    return rn.withColumn(out, bucket).drop("rn")


def quota_split(df: DataFrame, key: str, id_col: str, sizes: tuple[int, int, int], overlapping: list[str], full: list[str], reserved: Column, reserve: int, salt: str) -> DataFrame:
    """Rows (..., bucket 1-4), a row once for each bucket it is in.

    Usual strata: three ranges in shuffled order, and the rest. ``overlapping`` strata: head, tail and a reshuffled
    head, which may overlap, no rest. ``full`` strata: whole in buckets 1 to 3. Rows of ``reserved`` strata whose
    flag holds fill bucket 4 up to ``reserve``; what is left of the stratum is cut as usual.
    """
    a, b, c = sizes
    rows = df.withColumns({"_r": F.coalesce(reserved, F.lit(False)), "_o": R.key(salt, F.col(id_col)), "_again": R.key(salt + "again", F.col(id_col))})
    rows = placed(rows, [key], "_o", "_p", "_n")
    rows = placed(rows, [key], "_again", "_q")
    rows = placed(rows, [key, "_r"], "_o", "_h")
    rows = placed(rows.withColumn("_held", F.col("_r") & (F.col("_h") <= reserve)), [key, "_held"], "_o", "_s")
    s = F.col("_s")
    usual = F.array(F.when(s <= a, 1).when(s <= a + b, 2).when(s <= a + b + c, 3).otherwise(4))
    over = F.filter(F.array(F.when(F.col("_p") <= a, 1), F.when(F.col("_p") > F.col("_n") - b, 2), F.when(F.col("_q") <= c, 3)), lambda x: x.isNotNull())
    everywhere = F.array(F.lit(1), F.lit(2), F.lit(3))
    buckets = F.when(F.col(key).isin(*overlapping), over).when(F.col(key).isin(*full), everywhere).when(F.col("_held"), F.array(F.lit(4))).otherwise(usual)
    return rows.withColumn("bucket", F.explode(buckets)).drop("_r", "_o", "_again", "_p", "_n", "_q", "_h", "_held", "_s")


def thirds(plain: DataFrame, rest: DataFrame, key: str, id_col: str, n: int, salt: str) -> DataFrame:
    """Rows (key, id, bucket, pool): ``rest`` cut into three disjoint ranges of ``n`` where it has more than 3 n rows; else into thirds, each topped up to ``n`` with the same head of ``plain``."""
    cut = placed(rest.select(key, id_col, R.key(salt, F.col(id_col)).alias("_o")), [key], "_o", "rn", "cnt").drop("_o")
    third = F.greatest(F.floor(F.col("cnt") / 3), F.lit(1))
    small = F.least(F.floor((F.col("rn") - 1) / third), F.lit(2)) + 1
    large = F.when(F.col("rn") <= 3 * n, F.floor((F.col("rn") - 1) / n) + 1)
    first = cut.withColumn("bucket", F.when(F.col("cnt") > 3 * n, large).otherwise(small).cast("int")).where("bucket IS NOT NULL")
    have = cut.groupBy(key).agg(F.count("*").alias("cnt"))
    head = placed(plain.select(key, id_col, R.key(salt, F.col(id_col)).alias("_o")), [key], "_o").join(have, key, "left").where(F.coalesce("cnt", F.lit(0)) <= 3 * n)
    need = head.withColumn("bucket", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    c = F.coalesce("cnt", F.lit(0))
    size = F.when(F.col("bucket") < 3, F.floor(c / 3)).otherwise(c - 2 * F.floor(c / 3))
    second = need.where(F.col("rn") <= F.lit(n) - size)
    return first.select(key, id_col, "bucket", F.lit("rest").alias("pool")).union(second.select(key, id_col, "bucket", F.lit("plain").alias("pool")))


def halves(df: DataFrame, order: str, key: str | None = None) -> DataFrame:
    """Adds ``half``: 1 for the first floor(n / 2) rows (of each ``key``) in ``order``, a column of hex digits, else 2."""
    rows = placed(df, [key] if key else [], order, "_place", "_size")
    return rows.withColumn("half", F.when(F.col("_place") <= F.floor(F.col("_size") / 2), 1).otherwise(2)).drop("_place", "_size")
