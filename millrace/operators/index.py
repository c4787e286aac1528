"""A vector index in files: build, save, load and search by inner product.

Vectors are dealt to lists by their nearest centroid and written partitioned by list, so a search reads only the
lists that it opens. Each list keeps its middle, the radius around it that holds all of the list, and its largest
norm: no vector of a list scores above q * middle + |q| * radius, nor above |q| * norm. An exact search opens the
nearest lists first and then only those whose bound reaches the k-th score found. A search of a fixed number of lists
is approximate; ``probes`` is the smallest number that found RECALL of the true neighbours of MEASURED vectors when the
index was built. Centroids come from k-means on a bounded sample (TRAIN_ROWS, dealt by a hash of the id); all vectors
are indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import cut
from millrace.operators import vector
from millrace.sources import io

TRAIN_ROWS = 100_000
MEASURED = 200
NEIGHBOURS = 10
RECALL = 0.92
#: Scores are rounded to 6 digits, so a list may hold a tie a little below its bound.
SLACK = 1e-6


@dataclass
class Index:
    """``centroids``, ``middle``, ``radius`` and ``norm``: one row a list; ``rows``: (id, vec, list), a table partitioned by list; ``probes`` with their measured ``recall``."""

    centroids: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: DataFrame
    probes: int
    recall: float

    @property
    def lists(self) -> int:
        return len(self.centroids)


def _nearest(centroids: np.ndarray, n: int):
    """A function of vectors: the n lists whose centroids have the largest inner product, the best first."""

    @F.pandas_udf("array<int>")
    def lists(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        score = np.stack(vec.to_numpy()) @ centroids.T
        return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return lists


def _trained(corpus: DataFrame, lists: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    parts = max(1, -(-corpus.count() // TRAIN_ROWS))
    sample = corpus.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select(array_to_vector("vec").alias("features"))
    found = np.array(KMeans(k=lists, seed=seed, maxIter=20).fit(sample).clusterCenters())
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(size > 0, size, 1)


def build(corpus: DataFrame, path: str, lists: int = 1, seed: int = 42) -> Index:
    """Indexes rows (id, vec) of vectors of doubles, all of one length, in ``path`` and loads the index."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = corpus.sparkSession
    first = corpus.select(F.size("vec")).first()
    if first is None:
        raise ValueError("no vectors to index")
    centroids = _trained(corpus, lists, seed) if lists > 1 else np.zeros((1, first[0]))
    place = F.get(_nearest(centroids, 1)("vec"), F.lit(0)) if lists > 1 else F.lit(0)
    corpus.select("id", "vec", place.alias("list")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    middles = rows.groupBy("list").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("middle"))
    away = F.sqrt(F.aggregate(F.zip_with("vec", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    held = rows.join(F.broadcast(middles), "list").groupBy("list").agg(F.first("middle").alias("middle"), F.max(away).alias("radius"), F.max(F.sqrt(vector.dot("vec", "vec"))).alias("norm"))  # a row a list
    known = {r["list"]: r for r in held.collect()}
    nothing = {"middle": [0.0] * first[0], "radius": 0.0, "norm": 0.0}
    table = [(i, c.tolist(), *(known.get(i, nothing)[x] for x in ("middle", "radius", "norm"))) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "list int, vec array<double>, middle array<double>, radius double, norm double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    probes, recall = _measured(rows, centroids) if lists > 1 else (1, 1.0)
    spark.createDataFrame([(probes, recall)], "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/measured")
    return load(spark, path)


def _measured(rows: DataFrame, centroids: np.ndarray) -> tuple[int, float]:
    """(probes, recall): the fewest lists that hold RECALL of the true neighbours of about MEASURED vectors."""
    parts = max(1, -(-rows.count() // MEASURED))
    asked = rows.where(F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)) == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    ranked = asked.withColumn("order", _nearest(centroids, len(centroids))("qvec")).select("query_id", "order")
    best = vector.nearest(rows, asked, NEIGHBOURS, tag="list").join(ranked, "query_id")
    at = best.select(F.array_position("order", F.col("list")).alias("at")).groupBy("at").count().collect()  # a row a list
    found = np.zeros(len(centroids) + 1)
    for r in at:
        found[r["at"]] = r["count"]
    share = np.cumsum(found) / max(found.sum(), 1)
    probes = int(np.argmax(share >= RECALL)) if found.sum() else len(centroids)
    return probes, float(share[probes]) if found.sum() else 1.0


def load(spark: SparkSession, path: str) -> Index:
    for part in ("rows", "centroids", "measured"):
        if not io.exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"no index in {path}: {part} is missing")
    table = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # a row a list
    column = lambda c: np.array([r[c] for r in table])
    probes, recall = spark.read.parquet(f"{path}/measured").first()
    return Index(*(column(c) for c in ("vec", "middle", "radius", "norm")), spark.read.parquet(f"{path}/rows"), probes, recall)


def _in_lists(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k best for each query of (query_id, qvec, list, ...) in the lists asked for: only their folders are read."""
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # at most a row a list
    rows = index.rows.where(F.col("list").isin(wanted))
    return vector.nearest(rows, asked.select("query_id", "qvec", "list"), k, other=False, on="list")


def _with_columns(best: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the other columns of the queries."""
    more = [c for c in queries.columns if c not in ("query_id", "qvec")]
    return best.join(queries.select("query_id", *more), "query_id") if more else best


def _bounds(index: Index):
    """A function of vectors: (list, bound) of every list, the bound being no less than any score in it."""
    middle, radius, norm = index.middle, index.radius, index.norm

    @F.pandas_udf("array<struct<list:int,bound:double>>")
    def bounds(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        q = np.stack(vec.to_numpy())
        size = np.linalg.norm(q, axis=1)[:, None]
        top = np.minimum(q @ middle.T + size * radius, size * norm)
        top += 1e-9 * (size * np.maximum(norm, radius) + 1)
        return pd.Series([[{"list": i, "bound": b} for i, b in enumerate(row)] for row in top.tolist()])

    return bounds


def _opened(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(best of the nearest lists, rows (query columns, list, late) of the lists that an exact search opens)."""
    early = queries.withColumn("list", F.explode(_nearest(index.centroids, index.probes)("qvec")))
    first = cut(_in_lists(index, early, k), "nearest", result=True)
    reached = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).select("query_id", F.when(F.col("found") >= k, F.col("least")).alias("least"))
    every = queries.withColumn("b", F.explode(_bounds(index)("qvec"))).select(*queries.columns, "b.list", "b.bound").join(reached, "query_id", "left")
    late = every.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    late = late.join(early.select("query_id", "list"), ["query_id", "list"], "left_anti").select(*queries.columns, "list")
    return first, cut(early.select(*queries.columns, "list", F.lit(False).alias("late")).unionByName(late.withColumn("late", F.lit(True))), "opened", result=True)


def opened(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, early, late): how many lists an exact search opens for each query, the nearest and those whose bound reaches its k-th score."""
    _, lists = _opened(index, queries, k)
    return lists.groupBy("query_id").agg(F.count_if(~F.col("late")).alias("early"), F.count_if(F.col("late")).alias("late"))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Rows (query columns, id, score, rank): the k best for queries (query_id, qvec, ...), exact; with ``probes`` the best of that many nearest lists (``index.probes`` of them find ``index.recall`` of all)."""
    if probes is not None and probes < index.lists:
        asked = queries.withColumn("list", F.explode(_nearest(index.centroids, probes)("qvec")))
        return _with_columns(_in_lists(index, asked, k), queries)
    first, lists = _opened(index, queries, k)
    more = _in_lists(index, lists.where("late"), k)
    return _with_columns(vector.top_k(first.unionByName(more).drop("rank"), k), queries)
