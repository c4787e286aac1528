"""Scores by blocks against a row for each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import assign, vector

SCHEMA = "id long, label int, vec array<double>"


def cases():
    """Coarse components, so that many scores tie or lie half way between two roundings; equal vectors, and rows that fit no block."""
    draw = np.random.default_rng(3)
    rows = [(i, int(i % 4) if i % 9 else None, [float(x) for x in draw.integers(-9, 9, 6) * 0.0005 * (1 + i % 5)]) for i in range(260)]
    rows += [(300 + i, 1, rows[20][2]) for i in range(9)]
    return rows + [(400, 2, None), (405, 2, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (None, 1, [0.1] * 6), (407, 3, [4e5, -3.0, 1.0, 0.0, 0.5, 2.5e7])]


@pytest.mark.parametrize("most", [20_000, 5])
def test_blocks_equal_pairs(spark, monkeypatch, most):
    df = spark.createDataFrame(cases(), SCHEMA)
    queries = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("topic"), F.col("vec").alias("qvec"))
    pairs = vector.scores(df, queries).where("id <> query_id").persist()
    best = lambda k: sorted(map(tuple, vector.top_k(pairs, k).select("query_id", "id", "label", "score", "rank").collect()), key=str)
    want = [best(1), best(7)]
    limits = queries.select("query_id", "qvec", F.when(F.col("query_id") < 100, 0.0).otherwise(0.00002).alias("threshold"))
    over = pairs.join(limits.drop("qvec"), "query_id").where("score >= threshold").groupBy("query_id", "threshold").agg(F.count("*").alias("n"), F.min("id").alias("least_id"), F.max("score").alias("best"))
    want_over = sorted(map(tuple, over.collect()))
    stats = lambda df: sorted(((r["id"], str(r["topic"]), r["matches"], float(f"{r['mean_score']:.11g}")) for r in df.collect()), key=str)
    want_stats = stats(assign.topic_stats(pairs.where("score >= 0.00001")))
    for name, n in {"BLOCK": 40, "ASK": 7, "SUPER": 3, "PARTS": 4}.items():
        monkeypatch.setattr(vector, name, n)
    # the pairs aren't made row by row
    made = vector.scores
    monkeypatch.setattr(vector, "scores", lambda corpus, queries, on=None: made(corpus, queries, on).where(F.when(F.col("id").isNull() | F.col("id").isin(400, 405, 407) | F.col("query_id").isin(400), True).otherwise(F.raise_error("a row for a pair").cast("boolean"))))
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", most)
    if most < 100:
        monkeypatch.setattr(vector, "scores", made)
    for k, rows in zip((1, 7), want, strict=True):
        assert sorted(map(tuple, vector.nearest(df, queries, k, tag="label").select("query_id", "id", "label", "score", "rank").collect()), key=str) == rows
    assert sorted(map(tuple, vector.hits(df, limits).collect())) == want_over
    assert stats(vector.topic_totals(df, queries, 0.00001)) == want_stats
    pairs.unpersist()


def test_micros_round_as_spark_does(spark):
    draw = np.random.default_rng(8)
    a, b = draw.integers(-2000, 2000, (40, 3)) / 2048.0, draw.integers(-2000, 2000, (50, 3)) / 3125.0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "id long, vec array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "query_id long, qvec array<double>")
    got = vector.micros(a, b) / 1e6
    assert all(got[r["query_id"], r["id"]] == r["score"] for r in vector.scores(rows, asked).collect())
