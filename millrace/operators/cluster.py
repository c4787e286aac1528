"""Density clustering, projection and cluster samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import cut as saved


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """Rows (id, label) of points (id, x, y): -1 is noise, others the smallest core id of the cluster.

    Points are dealt into cells of side eps; a point meets the 9 cells around it in an equi-join. A point with at
    least ``least`` points within eps (itself included) is core; core points within eps are one cluster (smallest
    labels spread until none changes); a border point takes the smallest label within reach.
    """
    cell = points.withColumn("cx", F.floor(F.col("x") / eps)).withColumn("cy", F.floor(F.col("y") / eps))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = cell.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spread = spread.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    reach = (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= eps * eps
    pairs = saved(spread.join(cell, ["cx", "cy"]).where(reach).select("a", F.col("id").alias("b")), "near")
    core = saved(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id")), "core")
    links = saved(pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi"), "links")
    labels = saved(core.withColumn("label", F.col("id")), "labels")
    while True:
        best = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
        # jump to the label of the label, so long chains close in few rounds
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        fresh = saved(best.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        same = fresh.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty()
        labels = fresh
        if same:
            break
    border = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("border"))
    return points.select("id").join(labels, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "border", F.lit(-1).cast("bigint")).alias("label"))


def project(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """Principal components as a stand-in for a neighbour embedding: adds ``projection``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    return model.transform(rows).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")


def image_shares(pixels: str, low: int = 50, high: int = 205, threshold: float = 0.9):
    """black or white if that share of the grey values is dark or bright, else null."""
    n = F.size(pixels)
    dark = F.try_divide(F.size(F.filter(pixels, lambda p: p <= low)), n)
    bright = F.try_divide(F.size(F.filter(pixels, lambda p: p >= high)), n)
    return F.when(dark >= threshold, "black").when(bright >= threshold, "white")


def one_colour(pixels: str):
    return F.size(F.array_distinct(pixels)) == 1
