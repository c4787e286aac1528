"""The neighbour embedding and the bounded vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import embed, index

SCHEMA = "id long, vec array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups(n, groups_, spread, seed=0, dims=24):
    g = np.random.default_rng(seed)
    return unit(g.normal(size=(groups_, dims))[g.integers(groups_, size=n)] + spread * g.normal(size=(n, dims)))


def trustworthiness(vecs, flat, k):
    """1 if every point's k neighbours in the plane are among its k neighbours in space."""
    n = len(vecs)
    far = -vecs @ vecs.T
    np.fill_diagonal(far, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1) + 1
    gap = ((flat[:, None] - flat[None]) ** 2).sum(-1)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1)[:, :k]
    return 1 - 2 * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum() / (n * k * (2 * n - 3 * k - 1))


def frame(spark, vecs):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], SCHEMA)


@pytest.fixture(scope="module")
def blobs(spark):
    vecs = groups(400, 12, 0.3)
    return vecs, frame(spark, vecs).cache()


def test_graph_finds_the_neighbours(spark, blobs):
    vecs, points = blobs
    graph = embed.neighbours(points, 10).toPandas()
    sim = vecs @ vecs.T
    np.fill_diagonal(sim, -9)
    true = np.argsort(-sim, axis=1, kind="stable")[:, :10]
    found = graph.groupby("a")["b"].agg(set)
    assert len(graph) == 4000 and (graph["a"] != graph["b"]).all()
    assert np.mean([len(found[i] & set(true[i])) / 10 for i in range(len(vecs))]) >= 0.95
    assert np.allclose(graph["sim"], sim[graph["a"], graph["b"]], atol=1e-6)
    again = embed.neighbours(points.repartition(7), 10).toPandas()
    assert set(map(tuple, graph.to_numpy())) == set(map(tuple, again.to_numpy()))


def test_vectors_travel_to_changed_lists_only_with_the_same_graph(spark, blobs, monkeypatch):
    vecs, _ = blobs
    points = frame(spark, np.concatenate([vecs, vecs[:40]]).astype(np.float32).astype(float))
    met, real = [], embed._meet

    def meet(known, graph, lists, k):
        met.append(lists.count())
        return real(known, graph, lists, k)

    monkeypatch.setattr(embed, "_meet", meet)
    got = embed.neighbours(points, 5)
    light = embed._light(embed._whole(points)).cache()
    assert light.schema["vec"].dataType.elementType.typeName() == "float"
    graph = embed._first(light, 5, 24, 42).localCheckpoint()
    for _ in met:
        graph = embed._best(graph.unionAll(real(light, graph, embed._lists(graph, 5), 5)), 5).localCheckpoint()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.collect()))
    assert met[0] == 440 and met[-1] < 220
    tenth = embed._light(spark.createDataFrame([(1, [0.1, 0.2])], SCHEMA))
    assert tenth.schema["vec"].dataType.elementType.typeName() == "double"


def test_plane_keeps_neighbours_in_one_block_and_in_many(blobs):
    vecs, points = blobs
    edges = embed.weights(embed.neighbours(points, 10), 10).cache()
    whole = embed.layout(points, edges).orderBy("id").toPandas()
    assert trustworthiness(vecs, whole[["x", "y"]].to_numpy(), 10) >= 0.9
    again = embed.layout(points.repartition(5), edges).orderBy("id").toPandas()
    assert np.array_equal(whole.to_numpy(), again.to_numpy())
    blocks = embed.layout(points, edges, block=90).orderBy("id").toPandas()
    assert trustworthiness(vecs, blocks[["x", "y"]].to_numpy(), 10) >= 0.9


def test_memberships_of_either_direction(spark):
    graph = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 1, 0.9), (3, 1, 0.5), (3, 2, 0.1)], "a long, b long, sim double")
    found = {(r["a"], r["b"]): r["w"] for r in embed.weights(graph, 2).collect()}
    assert found[1, 2] == found[2, 1] == 1.0 and all(abs(found[a, b] - found[b, a]) < 1e-9 and 0 < found[a, b] <= 1 for a, b in found)
    one = embed._memberships(np.array([[0.1, 0.2, 0.4, np.inf]]), 4)
    assert one[0, 0] == 1 and one[0, 3] == 0 and 1 > one[0, 1] > one[0, 2] and abs(one.sum() - 2) < 1e-6


def test_odd_points(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0])]
    points = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["id"] for r in embed.embed(points, 3).collect()) == [1, 2, 7, 8]
    assert embed.embed(points.limit(0)).count() == 0 and embed.embed(points.where("id = 1")).count() == 1


def brute_top(vecs, asked, k):
    out = set()
    for q in asked:
        score = np.round(vecs @ vecs[q], 6)
        for rank, i in enumerate(np.lexsort((np.arange(len(vecs)), -score))[:k]):
            out.add((q, rank + 1, int(i)))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    g = np.random.default_rng(4)
    vecs = groups(900, 16, 0.2, 4) * (0.5 + g.random((900, 1)))
    vecs[17] = vecs[18]
    points = frame(spark, vecs)
    queries = points.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return vecs, index.build(points, str(tmp_path_factory.mktemp("index") / "i"), 16), queries


def rows(found):
    return {(r["query_id"], r["rank"], r["id"]) for r in found.collect()}


def test_bounded_search_is_exact_and_leaves_lists_closed(built):
    vecs, found, queries = built
    assert rows(index.search(found, queries, 7)) == brute_top(vecs, range(0, 900, 30), 7)
    lists = index.opened(found, queries, 7).toPandas()
    assert (lists["early"] == found.probes).all() and (lists["early"] + lists["late"]).mean() < found.lists / 2
    assert rows(index.search(found, queries, 2000)) == brute_top(vecs, range(0, 900, 30), 2000)


def test_bounds_hold_for_every_vector(built):
    vecs, found, _ = built
    held = found.rows.toPandas()
    for q in vecs[:20]:
        size = np.linalg.norm(q)
        top = np.minimum(found.middle @ q + size * found.radius, size * found.norm) + 1e-9
        assert (np.stack(held["vec"].to_numpy()) @ q <= top[held["list"].to_numpy()]).all()


def test_measured_probes_find_enough(spark, built, tmp_path):
    vecs, found, queries = built
    true = brute_top(vecs, range(0, 900, 30), 10)
    assert found.recall >= 0.9 and found.probes < found.lists
    assert len({(q, i) for q, _, i in true} & {(q, i) for q, _, i in rows(index.search(found, queries, 10, found.probes))}) >= 0.9 * len(true)
    random = unit(np.random.default_rng(1).normal(size=(600, 16)))
    spread = index.build(frame(spark, random), str(tmp_path / "r"), 12)
    asked = frame(spark, random).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    true = {(q, i) for q, _, i in brute_top(random, range(0, 600, 20), 10)}
    assert len(true & {(q, i) for q, _, i in rows(index.search(spread, asked, 10, spread.probes))}) >= 0.9 * len(true)
    assert rows(index.search(spread, asked, 10)) == brute_top(random, range(0, 600, 20), 10)
