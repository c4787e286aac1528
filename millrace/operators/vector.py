"""Vector search by inner product, label propagation and ranked cuts.

``nearest``, ``hits`` and ``topic_totals`` score a query set against every row without making a row of each pair: rows
and queries are packed into blocks, a pair of blocks is one product of matrices, and what is asked for (the best, the
hits, the totals) is taken from it in the task. A score is the sum of products in the order of components, rounded to
6 digits half up, as ``scores`` has it: where the product's rounding error could change a digit, the sum is taken again
in that order. Rows that don't fit a block (null ids, vectors of other lengths, null, non-finite or large components)
go through ``scores``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut, shared_path

BROADCAST_QUERIES = 20_000
#: Rows and queries of a block; where queries aren't broadcast, rows of a group that meets a query block in one key.
BLOCK, ASK, SUPER = 2048, 1024, 16
#: Tasks that hold the blocks, at most; each gives the best of its own.
PARTS = 128
LARGEST = 1e3
MICRO = 1e6
#: Stands for null among longs.
NONE = -(2**63)


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(c: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = as_doubles(c)
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def scores(corpus: DataFrame, queries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows (query columns, id, score) of every query with every row of the corpus, or with the rows that agree ``on`` columns of both.

    ``corpus``: (id, vec); ``queries``: (query_id, qvec, ...). A stated query set meets the corpus in blocks: up to
    BROADCAST_QUERIES queries travel to the corpus, which isn't shuffled; more are dealt into blocks of that size
    and each block joins a copy of the corpus by its number.
    """
    n = queries.count()
    blocks = max(1, -(-n // BROADCAST_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = queries.withColumn("block", block)
    held = corpus.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = held.join(F.broadcast(asked) if blocks == 1 else asked, ["block", *(on or [])])
    return joined.withColumn("score", F.round(dot("vec", "qvec"), 6)).drop("vec", "qvec", "block")


def _fits(i: str, v: str, dims: int) -> Column:
    return F.coalesce(F.col(i).isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)), F.lit(False))


def _meet(corpus: DataFrame, queries: DataFrame, tag: str | None = None, mark: str | None = None, on: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of blocks, scored rows of what doesn't fit a block, if any). Pairs: lane, ids, tags and values of rows, ids, marks and values of queries."""
    n_queries, dims = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    dims = max(dims or 0, 1)
    fits, asks = _fits("id", "vec", dims), _fits("query_id", "qvec", dims)
    n, odd = corpus.agg(F.count("*"), F.count_if(~fits)).first()
    keys = [on] if on else []
    rest = scores(corpus.where(~fits), queries, keys) if odd else None
    if queries.where(~asks).limit(1).count():
        more = scores(corpus.where(fits), queries.where(~asks), keys)
        rest = more if rest is None else rest.unionByName(more)
    few = n_queries <= BROADCAST_QUERIES
    if on:  # blocks by the largest group
        parts = min(PARTS, max(1, -(-n // BLOCK)))
        n, n_queries = (df.groupBy(on).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] for df in (corpus, queries))
    lanes, asked = max(1, -(-n // BLOCK)), max(1, -(-n_queries // ASK))
    parts = parts if on else min(PARTS, lanes)

    def packed(df: DataFrame, i: str, v: str, extra: str | None, name: str, count: int, parts: int) -> DataFrame:
        other = F.coalesce(F.col(extra), F.lit(NONE if df.schema[extra].dataType.typeName() != "double" else float("nan"))) if extra else F.lit(0)
        kind = "double" if extra and df.schema[extra].dataType.typeName() == "double" else "long"
        row = F.struct(F.col(i).cast("long").alias("i"), other.cast(kind).alias("o"), F.col(v).cast("array<double>").alias("v")).alias("row")
        # a number that adaptive execution doesn't lower, as few rows here are much work
        dealt = df.select(*keys, F.pmod(F.xxhash64(i, v), F.lit(count)).alias(name), row).repartition(parts, *keys, name)
        lists = dealt.groupBy(*keys, name).agg(F.collect_list("row").alias("rows"))
        return lists.select(*keys, name, F.col("rows.i").alias(f"{name}_i"), F.col("rows.o").alias(f"{name}_o"), F.flatten("rows.v").alias(f"{name}_v"))

    held, ask = packed(corpus.where(fits), "id", "vec", tag, "lane", lanes, parts), packed(queries.where(asks), "query_id", "qvec", mark, "ask", asked, min(PARTS, asked))
    if few:
        pairs = held.join(F.broadcast(ask), keys) if keys else held.crossJoin(F.broadcast(ask))
    else:
        held = held.withColumn("super", F.floor(F.col("lane") / SUPER)).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)).cast("array<long>")))
        ask = ask.withColumn("super", F.explode(F.sequence(F.lit(0), F.lit((lanes - 1) // SUPER)).cast("array<long>")))
        pairs = held.join(ask.hint("merge"), [*keys, "super", "ask"])
    return pairs.select(*(F.struct(*keys, x).cast("string").alias(x) for x in ("lane", "ask")), "lane_i", "lane_o", "lane_v", "ask_i", "ask_o", "ask_v"), rest


def micros(queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Scores [query, row] in millionths, rounded half up."""
    s = (queries @ vecs.T) * MICRO
    low = np.floor(s)
    s -= low
    size = np.sqrt((queries**2).sum(1).max(initial=0) * (vecs**2).sum(1).max(initial=0))
    s -= 0.5
    near = np.abs(s) <= 1e-9 + 4 * (queries.shape[1] + 4) * 2.0**-52 * size * MICRO
    low += s > 0
    a, b = np.nonzero(near)
    for at in range(0, len(a), 2**16):
        i, j = a[at : at + 2**16], b[at : at + 2**16]
        sums = np.zeros(len(i))
        for c in range(queries.shape[1]):
            sums += vecs[j, c] * queries[i, c]
        low[i, j] = [int(Decimal(repr(x)).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for x in sums.tolist()]
    return low


def _blocks(batches: Iterator[pa.RecordBatch], other: bool) -> Iterator[tuple]:
    """(lane, ask, rows' ids and tags, queries' ids and marks, scores [query, row] in millionths), rows in the order of ids; with ``other`` a row's score with itself is -inf."""
    for batch in batches:
        for r in range(batch.num_rows):
            lane, ask = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            i, o, v, qi, qo, qv = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(2, 8))
            order, asked = np.argsort(i, kind="stable"), np.argsort(qi, kind="stable")
            i, o, qi, qo = i[order], o[order], qi[asked], qo[asked]
            m = micros(qv.reshape(len(qi), -1)[asked], v.reshape(len(i), -1)[order])
            if other:
                for h in np.flatnonzero(np.isin(i, qi)):
                    m[qi == i[h], h] = -np.inf
            yield lane, ask, i, o, qi, qo, m


def _best_rows(m: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of scores that may be among a query's k best and aren't below ``least``."""
    if m.shape[1] > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k])
    return np.nonzero((m >= least[:, None]) & (m > -np.inf))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, other: bool = True, tag: str | None = None, on: str | None = None) -> DataFrame:
    """Rows (query_id, id, score, rank and the rows' column ``tag``, an integer): the k best rows for each query, ties to the smaller id.

    ``corpus``: (id, vec, ...); ``queries``: (query_id, qvec, ...), ids are longs. ``other`` leaves out a query's own row; ``on`` names a column of both that must agree.
    """
    pairs, rest = _meet(corpus, queries, tag, None, on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, names = {}, {}
        for _, ask, i, o, qi, _, m in _blocks(batches, other):
            # queries of a block keep their places: it is packed once
            q, s, r, t, least = kept.get(ask) or (np.zeros(0, int), np.zeros(0), *np.zeros((2, 0), np.int64), np.full(len(qi), -np.inf))
            a, b = _best_rows(m, least, k)
            q, s, r, t = np.concatenate([q, a]), np.concatenate([s, m[a, b]]), np.concatenate([r, i[b]]), np.concatenate([t, o[b]])
            order = np.lexsort((r, -s, q))
            q, s, r, t = q[order], s[order], r[order], t[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
            full = place == k - 1
            least = least.copy()
            least[q[full]] = s[full]
            keep = place < k
            kept[ask] = q[keep], s[keep], r[keep], t[keep], least
            names[ask] = qi
        for ask, (q, s, r, t, _) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(names[ask][q]), pa.array(r), pa.array(t), pa.array(s / MICRO)], ["query_id", "id", "tag", "score"])

    found = pairs.mapInArrow(run, "query_id long, id long, tag long, score double")
    columns = ["query_id", "id", "score"]
    if tag:
        found = found.withColumn(tag, F.when(F.col("tag") != NONE, F.col("tag")).cast(corpus.schema[tag].dataType))
        columns.append(tag)
    found = found.select(*columns)
    if rest is not None:
        found = found.unionByName((rest.where("id <> query_id") if other else rest).select(*columns))
    return top_k(found, k)


def hits(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, threshold, n, least_id, best) of the other rows that score at least a query's ``threshold``, from queries (query_id, qvec, threshold)."""
    pairs, rest = _meet(corpus, queries, mark="threshold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, i, _, qi, limit, m in _blocks(batches, True):
            m /= MICRO
            hit = m >= limit[:, None]
            n = hit.sum(1)
            some = np.flatnonzero(n)
            cols = qi[some], limit[some], n[some], i[hit[some].argmax(1)] if len(some) else i[:0], m[some].max(1) if len(some) else m[:0, 0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "threshold", "n", "least_id", "best"])

    found = pairs.mapInArrow(run, "query_id long, threshold double, n long, least_id long, best double")
    if rest is not None:
        found = found.unionByName(rest.where("id <> query_id AND score >= threshold").select("query_id", "threshold", F.lit(1).cast("long").alias("n"), F.col("id").alias("least_id"), F.col("score").alias("best")))
    return found.groupBy("query_id", "threshold").agg(F.sum("n").alias("n"), F.min("least_id").alias("least_id"), F.max("best").alias("best"))


def topic_totals(corpus: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Rows (id, topic, matches, mean_score) of the rows' scores of at least ``least`` with other queries (query_id, qvec, topic; an integer)."""
    pairs, rest = _meet(corpus, queries, mark="topic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, sums = None, np.zeros(0, np.int64), {}

        def held() -> Iterator[pa.RecordBatch]:
            for topic, (n, total) in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(np.full(len(some), topic)), pa.array(n[some]), pa.array(total[some])], ["id", "topic", "matches", "total"])

        for lane, _, i, _, _, topics, m in _blocks(batches, True):
            if lane != at:  # a block meets its queries one after another
                yield from held()
                at, rows, sums = lane, i, {}
            hit = m / MICRO >= least
            m[~hit] = 0
            for topic in np.unique(topics).tolist():
                own = topics == topic
                n, total = sums.get(topic, (0, 0))
                sums[topic] = n + hit[own].sum(0), total + m[own].sum(0)
        yield from held()

    found = pairs.mapInArrow(run, "id long, topic long, matches long, total double")
    kind = queries.schema["topic"].dataType
    found = found.withColumn("topic", F.when(F.col("topic") != NONE, F.col("topic")).cast(kind))
    if rest is not None:
        found = found.unionByName(rest.where(f"id <> query_id AND score >= {least!r}").select("id", "topic", F.lit(1).cast("long").alias("matches"), (F.col("score") * MICRO).alias("total")))
    matches = F.sum("matches")
    return found.groupBy("id", "topic").agg(matches.alias("matches"), (F.sum("total") / (matches * F.lit(MICRO))).alias("mean_score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows of each query (partial and final group limits), ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def sticky_threshold(queries: DataFrame, order: str, text: str, high: float = 0.45, low: float = 0.4, commas: int = 8, sticky: bool = True) -> DataFrame:
    """Adds ``threshold``: ``low`` from the first query with more than ``commas`` commas on (or for those queries alone).

    The running flag is the position of the first such query, one aggregated row, so no window over all queries.
    """
    long_ = F.regexp_count(text, F.lit(",")) > commas
    if not sticky:
        return queries.withColumn("threshold", F.when(long_, low).otherwise(high))
    first = queries.where(long_).agg(F.min(order).alias("first_long"))
    return queries.join(F.broadcast(first), F.lit(True), "left").withColumn("threshold", F.when(F.col(order) >= F.col("first_long"), low).otherwise(high)).drop("first_long")


def nearest_label(scored: DataFrame, label: str) -> DataFrame:
    """For each query the label and score of its best row, ties to the smaller id."""
    best = F.max_by(F.struct(F.col(label).alias("label"), F.col("id").alias("nearest"), "score"), F.struct("score", (-F.col("id")).alias("tie")))
    return scored.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.label", "b.nearest", "b.score")


def quota(df: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each label."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("place") <= n)


def quota_until_full(df: DataFrame, label_of: Callable[[DataFrame], DataFrame], label: str, labels: int, order: list[Column], n: int, parts: int = 64) -> tuple[DataFrame, int]:
    """(the first ``n`` rows of each label with their ``place``, ranges read): as ``quota`` over ``label_of(df)``, for a labelling that costs much.

    Rows are dealt into ``parts`` ranges of the order, which must be total. Ranges are labelled in growing groups,
    1, 2, 4, ... at a time, until ``labels`` different labels have n rows each or no range is left; a range that isn't
    reached is neither labelled nor read. ``label_of`` adds the column ``label`` row by row; rows with a null label
    count for none.
    """
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(parts, *names).withColumn("_range", F.spark_partition_id())
    path = shared_path(df.sparkSession, "quota")
    dealt.write.partitionBy("_range").parquet(path)
    ranges = df.sparkSession.read.schema(dealt.schema).parquet(path)
    kept, at, step = None, 0, 1
    while at < parts:
        group = ranges.where((F.col("_range") >= at) & (F.col("_range") < min(at + step, parts))).drop("_range")
        found = quota(label_of(group).where(F.col(label).isNotNull()), label, [F.col(c) for c in names], n).drop("place")
        found = cut(found, "quota", result=True)
        kept = found if kept is None else kept.unionByName(found)
        at, step = min(at + step, parts), step * 2
        full = kept.groupBy(label).agg(F.count("*").alias("rows")).where(F.col("rows") >= n).count()
        if full >= labels:
            break
    return quota(kept, label, [F.col(c) for c in names], n).drop(*names), at
