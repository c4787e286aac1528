"""A two-dimensional neighbour embedding of vectors, without meeting all pairs.

``neighbours`` builds a graph of near neighbours by NN-descent: a first graph from blocks of points that lie side by
side along a few random directions, then rounds in which the neighbours of a point (its own and those that list it)
are compared with each other. ``weights`` turns similarities into memberships with a bandwidth for each point.
``layout`` starts from principal components and pulls linked points together, pushing them away from a sample, block
of points by block; points of other blocks stand still within a round.

Every draw is a function of ids, a seed and the round, and similarities are rounded, so a run can be repeated.
Vectors that are null, empty or hold null or non-finite numbers take no part. The graph is approximate; PER_POINT
bounds how many links of a point the layout follows (the strongest), REPEL how many points of the sample push.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut, scratch
from millrace.functions.position import numbered
from millrace.operators import vector
from millrace.operators.cluster import project

NEIGHBOURS = 15
DIRECTIONS = 3
BLOCK = 256
SETTLED = 0.002
MOST_ROUNDS = 12
LAYOUT_BLOCK = 20_000
LAYOUT_ROUNDS = 10
EPOCHS = 30
REPEL = 5_000
PUSHES = 5
PER_POINT = 60
DIGITS = 9
#: 1 / (1 + A * d ** (2 * B)) is close to 1 up to a distance of 0.1 and falls off as exp(-d) beyond.
A, B = 1.577, 0.8951


def _whole(points: DataFrame) -> DataFrame:
    """Rows (id, vec): vectors of doubles as they are, those that take part."""
    vec = F.col("vec").cast("array<double>")
    whole = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return points.where(F.col("id").isNotNull() & whole).select("id", vec.alias("vec")).dropDuplicates(["id"])


def usable(points: DataFrame) -> DataFrame:
    """Rows (id, vec): unit vectors of doubles."""
    return _whole(points).select("id", vector.normalized(F.col("vec")).alias("vec"))


def _light(points: DataFrame) -> DataFrame:
    """Rows (id, vec, norm) of rows (id, vec): vectors to be divided by their lengths where they are used, as floats if all of them are."""
    short = F.col("vec").cast("array<float>")
    same = points.where(short.cast("array<double>") != F.col("vec")).isEmpty()
    return points.select("id", (short if same else F.col("vec")).alias("vec"), F.sqrt(vector.dot(F.col("vec"), F.col("vec"))).alias("norm"))


def _unit(vecs: list, norms: np.ndarray) -> np.ndarray:
    return np.array(vecs, float) / np.where(norms > 0, norms, 1.0)[:, None]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar of each ``a``, from rows (a, b, sim) that may repeat."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("_n") <= k).drop("_n")


def _similar(ids: np.ndarray, vecs: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim): of each point its k most similar others, those above the point's ``floor``."""
    sim = np.round(vecs @ vecs.T, DIGITS)
    np.fill_diagonal(sim, -np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
    row = np.repeat(np.arange(len(ids)), near.shape[1])
    col = near.ravel()
    keep = sim[row, col] > floor[row]
    return ids[row[keep]], ids[col[keep]], sim[row[keep], col[keep]]


def _first(points: DataFrame, k: int, dims: int, seed: int) -> DataFrame:
    found, unit = None, F.when(F.col("norm") > 0, F.transform("vec", lambda x: x.cast("double") / F.col("norm"))).otherwise(F.col("vec").cast("array<double>"))
    for way in range(DIRECTIONS):
        direction = np.random.default_rng([seed, way]).normal(size=dims)
        along = F.aggregate(F.zip_with(unit, F.array(*map(F.lit, direction.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        places = numbered(points.select("id", F.round(along, DIGITS).alias("along")), [], ["along", "id"], "place").select("id", F.floor(F.col("place") / BLOCK).alias("block"))

        def within(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            a, b, sim = _similar(rows["id"].to_numpy(), _unit(list(rows["vec"]), rows["norm"].to_numpy()), np.full(len(rows), -np.inf), k)
            return pd.DataFrame({"a": a, "b": b, "sim": sim})

        pairs = places.join(points, "id").groupBy("block").applyInPandas(within, "a long, b long, sim double")
        found = pairs if found is None else found.unionAll(pairs)
    return _best(found, k)


def _lists(graph: DataFrame, k: int) -> DataFrame:
    """Rows (c, ms): each point with its neighbours, those that list it (the k nearest) and itself, at most 2 k + 1."""
    back = graph.select(F.col("b").alias("c"), F.col("a").alias("m"), "sim")
    back = back.withColumn("_n", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("sim"), "m"))).where(F.col("_n") <= k)
    members = graph.select(F.col("a").alias("c"), F.col("b").alias("m")).union(back.select("c", "m")).union(graph.select(F.col("a").alias("c"), F.col("a").alias("m")).distinct())
    return members.groupBy("c").agg(F.array_sort(F.collect_set("m")).alias("ms"))


def _meet(points: DataFrame, graph: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b, sim) of points of one list, where they beat a's last one."""
    members = lists.select("c", F.explode("ms").alias("m"))
    last = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    known = points.join(last, points["id"] == last["a"]).select(F.col("id").alias("m"), "floor", "vec", "norm")
    lists = members.join(known, "m").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("m", "floor", "vec", "norm"))).alias("l"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch["l"]:
                found.append(_similar(np.array([x["m"] for x in row]), _unit([x["vec"] for x in row], np.array([x["norm"] for x in row])), np.array([x["floor"] for x in row]), k))
            if found:
                yield pd.DataFrame(dict(zip(("a", "b", "sim"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    return lists.select("l").mapInPandas(local, "a long, b long, sim double")


def neighbours(points: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Rows (a, b, sim): about the k nearest others of each point (id, vec) by cosine, by NN-descent. Rounds end when fewer than SETTLED of the links change.

    Vectors travel only to lists that aren't the same as a round before: the pairs of those were given then, and what
    wasn't kept of them is below a last neighbour that only gets nearer.
    """
    with scratch():
        points = cut(_light(cut(_whole(points), "points")), "points")
        first = points.select(F.size("vec")).first()
        if first is None:
            return points.sparkSession.createDataFrame([], "a long, b long, sim double")
        graph = cut(_first(points, k, first[0], seed), "graph", result=True)
        before = None
        for _ in range(MOST_ROUNDS):
            lists = cut(_lists(graph, k), "lists")
            news = lists if before is None else lists.join(before, ["c", "ms"], "left_anti")
            fresh = cut(_best(graph.unionAll(_meet(points, graph, news, k)), k), "graph", result=True)
            before = lists
            changed = fresh.join(graph, ["a", "b"], "left_anti").count()
            graph = fresh
            if changed <= SETTLED * graph.count():
                break
    return graph


def _memberships(dist: np.ndarray, k: int) -> np.ndarray:
    """Rows of ascending distances, padded with inf: exp(-(d - nearest) / width), with widths such that a row sums to log2(k)."""
    held = np.isfinite(dist)
    nearest = np.where(held.any(1), np.min(np.where(held & (dist > 0), dist, np.inf), axis=1), 0.0)
    over = np.where(held, np.maximum(dist - np.where(np.isfinite(nearest), nearest, 0.0)[:, None], 0.0), np.inf)
    low, high = np.full(len(dist), 1e-9), np.full(len(dist), 1e3)
    for _ in range(60):
        mid = np.sqrt(low * high)
        wide = np.exp(-over / mid[:, None]).sum(1) > np.log2(k)
        low, high = np.where(wide, low, mid), np.where(wide, mid, high)
    return np.exp(-over / np.sqrt(low * high)[:, None])


def weights(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Rows (a, b, w) in both directions: membership of either in the other's neighbourhood."""
    lists = graph.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((1 - F.col("sim")).alias("d"), "b"))).alias("l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            dist = np.full((len(batch), max(map(len, batch["l"]))), np.inf)
            for i, row in enumerate(batch["l"]):
                dist[i, : len(row)] = [max(x["d"], 0.0) for x in row]
            sizes = [len(row) for row in batch["l"]]
            yield pd.DataFrame({"a": np.repeat(batch["a"].to_numpy(), sizes), "b": [x["b"] for row in batch["l"] for x in row], "w": _memberships(dist, k)[np.isfinite(dist)]})

    one = lists.mapInPandas(run, "a long, b long, w double")
    both = one.select("a", "b", "w", F.lit(0.0).alias("v")).unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    w, v = F.sum("w"), F.sum("v")
    return both.groupBy("a", "b").agg(F.round(w + v - w * v, DIGITS).alias("w")).where("w > 0")


def _moved(own: np.ndarray, head: np.ndarray, tail: np.ndarray, fixed: np.ndarray, weight: np.ndarray, sample: np.ndarray, epochs: range, total: int, draw: np.random.Generator) -> np.ndarray:
    """Positions of a block after some epochs. ``tail``: a point of the block, or -1 where ``fixed`` has the other end's place."""
    at, share = own.copy(), weight / weight.max() if len(weight) else weight
    for epoch in epochs:
        rate = 1.0 - epoch / total
        chosen = np.flatnonzero(draw.random(len(head)) < share)
        draw.shuffle(chosen)
        for part in np.array_split(chosen, 8):
            if not len(part):
                continue
            a, b = head[part], tail[part]
            other = np.where(b[:, None] >= 0, at[np.maximum(b, 0)], fixed[part])
            gap = at[a] - other
            d2 = (gap**2).sum(1)
            pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0.0)
            step = np.clip(pull[:, None] * gap, -4, 4)
            if len(sample):
                away = at[a][:, None, :] - sample[draw.integers(len(sample), size=(len(part), PUSHES))]
                f2 = (away**2).sum(2)
                push = 2 * B / ((0.001 + f2) * (1 + A * f2**B))
                step = step + np.clip(np.where(f2[..., None] > 0, push[..., None] * away, 0.0), -4, 4).sum(1)
            np.add.at(at, a, rate * step)
    return at


def _mover(sample, seed: int, turn: int, epochs: int, total: int):
    """A function of a block's links and points: the points where ``epochs`` epochs take them."""

    def move(links: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own, links = own.sort_values("id"), links.sort_values(["a", "b"])
        ids, tail = own["id"].to_numpy(), links["b"].to_numpy()
        found = np.searchsorted(ids, tail)
        inside = (found < len(ids)) & (ids[np.minimum(found, len(ids) - 1)] == tail)
        draw = np.random.default_rng([seed, turn, int(own["block"].iloc[0])])
        new = _moved(own[["x", "y"]].to_numpy(), np.searchsorted(ids, links["a"].to_numpy()), np.where(inside, found, -1), links[["bx", "by"]].to_numpy(), links["w"].to_numpy(), sample.value, range(turn * epochs, (turn + 1) * epochs), total, draw)
        return pd.DataFrame({"id": ids, "block": own["block"].to_numpy(), "x": new[:, 0], "y": new[:, 1]})

    return move


def layout(points: DataFrame, edges: DataFrame, seed: int = 42, rounds: int = LAYOUT_ROUNDS, epochs: int = EPOCHS, block: int = LAYOUT_BLOCK) -> DataFrame:
    """Rows (id, x, y) of points (id, vec) with links (a, b, w) in both directions."""
    spark = points.sparkSession
    with scratch():
        points = cut(usable(points), "points")
        n = points.count()
        # fewer than three points have no plane of their own
        axes = project(points, "vec", 2) if n > 2 else points.withColumn("projection", F.array(F.lit(0.0), F.lit(0.0)))
        start = cut(axes.select("id", *(F.round(F.col("projection")[i], DIGITS).alias(c) for i, c in enumerate("xy"))), "start", result=not n)
        widest = start.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0]
        if not n:
            return start
        scale = 10.0 / widest if widest else 1.0
        # equal points are told apart by a little
        nudge = lambda c: F.pmod(F.xxhash64("id", F.lit(c), F.lit(seed)), F.lit(1000)) / 1e5
        place = numbered(start, [], ["x", "id"], "place")
        at = cut(place.select("id", F.floor(F.col("place") / block).alias("block"), *((F.col(c) * scale + nudge(c)).alias(c) for c in "xy")), "at")
        strong = edges.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).where(F.col("_n") <= PER_POINT).drop("_n")
        home = at.select(F.col("id").alias("a"), "block")
        strong = cut(strong.join(home, "a").select("block", "a", "b", "w"), "edges")
        for turn in range(rounds):
            sample = at.where(F.pmod(F.xxhash64("id", F.lit(turn), F.lit(seed)), F.lit(-(-n // REPEL))) == 0).orderBy("id").select("x", "y").toPandas().to_numpy()  # about REPEL rows
            other = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
            sent = spark.sparkContext.broadcast(sample)

            links = strong.join(other, "b").select("block", "a", "b", "w", "bx", "by")
            at = cut(links.groupBy("block").cogroup(at.groupBy("block")).applyInPandas(_mover(sent, seed, turn, epochs, rounds * epochs), "id long, block long, x double, y double"), "at", result=turn == rounds - 1)
    return at.select("id", "x", "y")


def embed(points: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Rows (id, x, y): points (id, vec) near by cosine lie near each other."""
    return layout(points, weights(neighbours(points, k, seed), k), seed)
