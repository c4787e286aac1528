"""Exact top-k by inner product on a bit-sliced index.

Components become integers floor(1024 x). Candidates are dealt into blocks of about BLOCK rows; in a block
each component, shifted to start at 0, is stored as bitmaps, one for each of its SLICES highest bits
(vertical slices over the rows). For a query the slices are weighted by the bits of its own components and
added with bitmap arithmetic (carry adders over whole bitmaps), a negative component adding the complement.
The top rows are then selected from the most significant sum slice downward. The bits that were left out
bound the error of a sum, so every row that could still belong to the top k lies within that margin of the
k-th sum: these boundary rows alone are scored exactly, ties going to the smaller id. Blocks' winners meet in
a ranked window with k rows a block.

Where a component of a row or a query is so large that slices or sums could leave 64 bits, the same two steps
run on doubles: the margin is the proven rounding error of the approximate sum, and the boundary rows are
scored in integers of any length.

Queries are a stated set and meet all candidates in blocks. Up to BROADCAST_QUERIES queries are broadcast, each once,
to candidate blocks that aren't copied. More are dealt to blocks of ASK queries, and each of these and a group of SUPER
candidate blocks is a key of its own in a sorted join, so nothing of them passes the driver.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without id; all others do, whatever their size. Ranks follow the exact scores; a score that a long can't hold
is returned as the nearest long. Vectors of different lengths have no score; vectors of any length are scored
whole; repeated rows are candidates once each, and all rows with the query's id are the query's own; of
several query rows with one id the smallest vector counts; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, ready, tidy

SCALE = 1024
BLOCK = 1024
QUERY_BLOCK = 512
BROADCAST_QUERIES = 20_000
ASK = 8192
SUPER = 16
SLICES = 8
NARROW = 2**62
LONG = 2**63


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps [component, bit from the lowest, words] of non-negative values [row, component]."""
    rows, dims = values.shape
    width = -(-rows // 64) * 64
    out = np.zeros((dims, bits, width // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((dims, width), np.uint8)
        plane[:, :rows] = ((values >> b) & 1).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out


def add_slices(a: list, b: list) -> list:
    """The sum of two bit-sliced numbers, lowest slice first."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x = a[i] if i < len(a) else None
        y = b[i] if i < len(b) else None
        known = [v for v in (x, y, carry) if v is not None]
        if len(known) == 1:
            out.append(known[0])
            carry = None
        elif len(known) == 2:
            out.append(known[0] ^ known[1])
            carry = known[0] & known[1]
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return out if carry is None else [*out, carry]


def weighted_sum(slices: np.ndarray, valid: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Sum slices [query, words], lowest first, of |weight| times the component, complemented where the weight is negative."""
    dims, bits, _ = slices.shape
    negative = np.where(queries < 0, np.uint64(2**64 - 1), np.uint64(0))
    size = np.abs(queries)
    signed = [slices[None, :, b] ^ negative[:, :, None] for b in range(bits)]
    signed = [s & valid for s in signed]
    total: list[np.ndarray] = []
    for k in range(int(size.max(initial=0)).bit_length()):
        mask = np.where((size >> k) & 1 == 1, np.uint64(2**64 - 1), np.uint64(0))[:, :, None]
        if not mask.any():
            continue
        level = [s & mask for s in signed]
        n = dims
        while n > 1:  # components in pairs
            half = n // 2
            summed = add_slices([s[:, :half] for s in level], [s[:, half : 2 * half] for s in level])
            if n % 2:
                last = [s[:, n - 1 : n] for s in level]
                last += [np.zeros_like(last[0])] * (len(summed) - len(last))
                summed = [np.concatenate([s, t], axis=1) for s, t in zip(summed, last, strict=True)]
            level, n = summed, half + n % 2
        part = [s[:, 0] for s in level]
        total = total[:k] + [np.zeros_like(part[0])] * max(0, k - len(total)) + add_slices(total[k:], part) if total else [np.zeros_like(part[0])] * k + part
    return total


def kth_largest(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum of each query, found from the most significant slice downward."""
    n = len(total[0])
    still = np.broadcast_to(valid, (n, len(valid))).copy()
    above = np.zeros(n, np.int64)
    value = np.zeros(n, np.int64)
    for b in range(len(total) - 1, -1, -1):
        ones = still & total[b]
        count = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        up = above + count >= k
        value += np.where(up, np.int64(1) << b, 0)
        above = np.where(up, above, above + count)
        still = np.where(up[:, None], ones, still & ~total[b])
    return value


def at_least(total: list[np.ndarray], valid: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is at least ``bound``."""
    n = len(total[0])
    same = np.broadcast_to(valid, (n, len(valid))).copy()
    more = np.zeros_like(same)
    for b in range(len(total) - 1, -1, -1):
        bit = ((bound >> b) & 1 == 1)[:, None]
        more |= np.where(bit, 0, same & total[b]).astype(np.uint64)
        same = np.where(bit, same & total[b], same & ~total[b])
    return more | same


def block_top(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's position, rows' places, exact scores) of each query's k best rows of a block; rows are in the order of ids."""
    low = values.min(axis=0)
    shifted = values - low
    bits = int(shifted.max(initial=0)).bit_length()
    drop = max(0, bits - SLICES)
    slices = slices_of(shifted >> drop, max(1, bits - drop))
    rows = len(ids)
    width = slices.shape[2]
    flags = np.zeros(width * 64, np.uint8)
    flags[:rows] = 1
    valid = np.packbits(flags, bitorder="little").view(np.uint64)
    top = (1 << slices.shape[1]) - 1
    step = max(1, 2**21 // max(1, slices[..., 0].size * width))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        total = weighted_sum(slices, valid, q)
        if not total:
            total = [np.zeros((len(q), width), np.uint64)]
        own = int((ids[:, None] == query_ids[None, at : at + step]).sum(axis=0).max())
        want = min(rows, k + own)
        kth = kth_largest(total, valid, want)
        # the sums leave out at most 2 ** drop - 1 a component, times its weight
        margin = (((1 << drop) - 1) * np.abs(q).sum(axis=1) >> drop) + 1 if drop else np.zeros(len(q), np.int64)
        near = at_least(total, valid, np.clip(kth - margin, 0, top * np.abs(q).sum(axis=1)))
        for i in range(len(q)):
            hit = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little", count=rows))
            score = values[hit] @ q[i]
            own = ids[hit] != query_ids[at + i]
            hit, score = hit[own], score[own]
            best = np.lexsort((ids[hit], -score))[:k]
            yield at + i, hit[best], score[best]


def exact_integers(vector: np.ndarray) -> list[int]:
    """floor(1024 x) of every component, as integers of any length."""
    return [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in vector.tolist()]


def beyond(score: int) -> str:
    """Orders scores that no long holds: larger texts for larger scores."""
    if -LONG <= score < LONG:
        return "n"
    size = score.bit_length()  # at most about 2100, as components are doubles
    if score > 0:
        return f"p{size:05d}{score:x}"
    return f"a{99999 - size:05d}{(1 << size) + score:0{size // 4 + 1}x}"


def wide_top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """(places, exact scores) of one query's k best rows, for vectors of doubles of any size."""
    hit = np.flatnonzero(ids != query_id)
    if len(hit) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            a, q = np.floor(vectors[hit] * SCALE), np.floor(query * SCALE)
            about, error = a @ q, (np.abs(a) @ np.abs(q)) * ((len(q) + 4) * 2.0**-50)
        if np.isfinite(about).all() and np.isfinite(error).all():
            hit = hit[about + error >= np.partition(about - error, len(hit) - k)[len(hit) - k]]
    weights = exact_integers(query)
    score = {int(i): sum(x * y for x, y in zip(exact_integers(vectors[i]), weights, strict=True)) for i in hit}
    best = sorted(score, key=lambda i: (-score[i], ids[i]))[:k]
    return best, [score[i] for i in best]


def any_top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(query's id, places, exact scores): rows among which are each query's k best of a block of vectors of doubles."""

    def sizes(rows: np.ndarray) -> np.ndarray:
        return np.abs(rows).max(axis=1, initial=0) * SCALE + 1

    # whose products, sums and shifts stay within 64 bits
    share = math.isqrt(NARROW // (8 * vectors.shape[1]))
    with np.errstate(over="ignore"):
        rows, asked = sizes(vectors) <= share, sizes(queries) <= share
    if rows.any() and asked.any():
        at, own = np.flatnonzero(rows), np.flatnonzero(asked)
        whole = [np.floor(x * SCALE).astype(np.int64) for x in (vectors[at], queries[own])]
        for j, best, score in block_top(ids[at], whole[0], query_ids[own], whole[1], k):
            yield int(query_ids[own[j]]), at[best].tolist(), score.tolist()
    for j in range(len(queries)):
        rest = np.flatnonzero(~rows) if asked[j] else np.arange(len(ids))
        if len(rest):
            best, score = wide_top(ids[rest], vectors[rest], query_ids[j], queries[j], k)
            yield int(query_ids[j]), rest[best].tolist(), score


def top_k(vectors: DataFrame, query_filter, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every vector that ``query_filter`` marks its k highest integer inner products with all others."""
    ready(vectors.sparkSession)
    vec = F.col("embedding")
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & finite)
    # rows that repeat are one row with its number of copies, so no id is a hot one
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id"), F.size(vec).alias("dims"), vec.cast("array<double>").alias("v")).agg(F.count("*").alias("copies"))
    rows = cut(rows, "vectors", result=True)
    queries = rows.where(query_filter(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("row")).select("vec_id", "row.dims", "row.v", F.lit(1).cast("long").alias("copies"))
    n_rows, n_queries = rows.count(), queries.count()
    blocks, few = max(1, -(-n_rows // BLOCK)), n_queries <= BROADCAST_QUERIES
    query_blocks = max(1, -(-n_queries // (QUERY_BLOCK if few else ASK)))
    supers = -(-blocks // SUPER)

    def dealt(df: DataFrame, n: int, name: str) -> DataFrame:
        lane = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias(name)
        lists = df.select("dims", lane, F.struct("vec_id", "v", "copies").alias("row")).groupBy("dims", name).agg(F.array_sort(F.collect_list("row")).alias("rows"))
        return lists.select("dims", name, F.col("rows.vec_id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_values"), F.col("rows.copies").alias(f"{name}_copies"))

    held, asked = dealt(rows, blocks, "block"), dealt(queries, query_blocks, "ask")
    if few:
        pairs = held.join(F.broadcast(asked), "dims")
    else:
        held = held.withColumn("super", F.floor(F.col("block") / SUPER)).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        asked = asked.withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(supers - 1)).cast("array<long>")))
        pairs = held.join(asked.hint("merge"), ["dims", "super", "ask"])
    pairs = pairs.select("dims", "block_ids", "block_values", "ask_ids", "ask_values", "block_copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(0)[i].as_py()
                ids, values, ask, weights, copies = (batch.column(c)[i].values.to_numpy() for c in range(1, 6))
                out: tuple[list, ...] = ([], [], [], [], [])
                for query, best, score in any_top(ids, values.reshape(-1, dims), ask, weights.reshape(-1, dims), k):
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(min(max(s, -LONG), LONG - 1) for s in score)
                    out[3].extend(map(beyond, score))
                    out[4].extend(copies[best].tolist())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score", "beyond", "copies"])

    found = pairs.mapInArrow(tidy(run), "query_id long, vec_id long, score long, beyond string, copies long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
