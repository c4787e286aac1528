"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct shingles of five words. Each of REGISTERS registers keeps the minimum of an
exponential variable over the set, on a logarithmic scale of base BASE and truncated to a byte: registers are
mergeable (by their maximum) and two sets agree in one with a probability close to their Jaccard similarity.

1. Documents with equal sets form a class; its smallest id stands for it. All further steps see classes only.
2. Bands of ROWS registers are hashed to buckets. Every member of a bucket is paired with the bucket's smallest
   member, its leader, so a bucket of n gives n - 1 pairs.
3. A pair's similarity is estimated jointly: with the known set sizes, the likelihood of the numbers of
   registers that are greater, less and equal. Pairs well below the threshold (SIGMAS standard errors) are
   dropped, the others are confirmed on their full sets.
4. Confirmed links give components. Members of one component need no more pairs. Buckets that still hold
   several components are taken in blocks of BLOCK members, and the members of different components are
   compared by their registers in memory; those of the bucket's largest component meet the others only, not
   each other. First only the likeliest pair of each two components leaves the
   task; these are confirmed like the others and the components are closed. Then all likely pairs of the
   components that are still apart are confirmed, and the components closed for good.

So every pair that shares a bucket is either judged or already connected. With 42 bands of 6 registers a pair
at similarity 0.85 shares none with a probability of 3e-9, at 0.8 of 3e-6. The bands take a quarter of the
registers; all of them serve the estimate, whose standard error at 0.85 is 0.011.

Defined results: words are runs of bytes other than blank and 0x09-0x0D, with A-Z in lower case; with fewer
than five words the whole sequence is the one shingle; a null or empty text has an empty set, is linked with
nothing and keeps its own id; texts of any length give their whole set; repeated rows get the same component
and are each returned; rows with one id and different texts are judged each by its own text; a null id is its
own (null) component unless its set equals another's; extra columns are ignored; an empty table gives no rows.
Sets are sets of 64-bit hashes of shingles, and are told apart by 128 bits; so are the counts and the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ready, scratch, tidy

WORDS = 5
BANDS, ROWS = 42, 6
REGISTERS = 4 * BANDS * ROWS
BASE = float(np.exp(0.1))
SIGMAS = 5.0
BLOCK = 1024
BROADCAST_IDS = 4_000_000

_rng = np.random.default_rng(7)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = (_rng.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(text: bytes) -> np.ndarray:
    """A 64-bit key for each word of the text, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    inside = data[~gap].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, size)
    inside *= _PLACES[place & 63] * (2 * place + 1).astype(np.uint64)
    return mix(np.add.reduceat(inside, first) + size.astype(np.uint64))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' keys in order."""
    words = word_keys(text or b"")
    n = len(words)
    if not n:
        return words
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, np.uint64) * _ORDER[WORDS]
    for j in range(width):
        total += words[j : n - width + 1 + j] * _ORDER[j]
    return np.unique(mix(total))


def marks(keys: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes, the same for equal sets."""
    return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (keys ^ np.uint64(0x51ED270B), keys + np.uint64(0x632BE5AB)))


def registers(keys: np.ndarray) -> np.ndarray:
    """The set's registers, a byte each; all 0 for the empty set."""
    if not len(keys):
        return np.zeros(REGISTERS, np.uint8)
    short = (keys >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256, None] * _SPREAD).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(25 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


@lru_cache(maxsize=1)
def _grid() -> np.ndarray:
    return np.arange(0.0, 1.0001, 0.01)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of register rows by maximum likelihood, to a hundredth."""
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_grid()[None, :], np.minimum(u / v, v / u))

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def lowest_estimate(percent: int) -> float:
    t = percent / 100
    return t - SIGMAS * float(np.sqrt(t * (1 - t) / REGISTERS))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tk, n_shingles, s1, s2, sketch); s1 and s2 tell sets apart, tk the texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, s1, s2, sketch = [], [], [], []
                for text in batch.column(2):
                    keys = shingle_set(text.as_py())
                    n.append(len(keys))
                    for column, value in zip((s1, s2), marks(keys), strict=True):
                        column.append(value)
                    sketch.append(registers(keys).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(sketch, pa.binary())], ["doc_id", "tk", "n_shingles", "s1", "s2", "sketch"])

    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text")).mapInArrow(tidy(run), "doc_id long, tk long, n_shingles long, s1 long, s2 long, sketch binary")


def node() -> Column:
    """The number of a class of equal sets, from s1, s2 and n."""
    return F.xxhash64(F.col("s1"), F.col("s2"), F.col("n").cast("long"))


def _sizes_allow(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose joint estimate isn't well below the threshold."""
    low = lowest_estimate(percent)
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                e = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.filter(pa.array(e >= low)).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidy(run), "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    pairs = cut(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = cut(ids.join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = [shingle_set(t.as_py()) for t in batch.column(0)]
                sums = [marks(k) for k in keys]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                values = ([x for x, _ in sums], [x for _, x in sums], [len(k) for k in keys], [k.tobytes() for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["s1", "s2", "n", "keys"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            good = []
            for x, y in zip(whole.column(2), whole.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(same * 100 >= (len(both) - same) * percent)
            yield whole.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi")
    keys = texts.select("text").mapInArrow(tidy(sets), "s1 long, s2 long, n long, keys binary")
    keys = cut(keys.select(node().alias("node"), "keys"), "sets").dropDuplicates(["node"])
    joined = pairs.join(keys.select(F.col("node").alias("b"), F.col("keys").alias("k_b")), "b").join(keys.select(F.col("node").alias("a"), F.col("keys").alias("k_a")), "a")
    return joined.select("a", "b", "k_a", "k_b").mapInArrow(tidy(judge), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all linked nodes: the smallest node reachable, by alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def crossing(members: DataFrame, classes: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Likely pairs (a, b) of different components that share a bucket, or only the likeliest of each two components in a block. ``members``: rows (key, band, node, component), a table. A pair is looked at in the first band that it shares."""
    low = lowest_estimate(percent)
    largest = members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("several"))
    largest = cut(largest.where("several > 1").select("key", F.col("most.component").alias("big"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("big_blocks"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("blocks")), "largest")
    is_big, own = F.col("component") == F.col("big"), F.xxhash64("node")
    rows = members.join(largest, "key").withColumn("own", F.when(is_big, F.col("blocks") + F.pmod(own, "big_blocks")).otherwise(F.pmod(own, "blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_big, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("big_blocks") - 1))))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "band", "node", "component").join(classes.select("node", "n", "sketch"), "node")
    rows = rows.select("key", "x", "y", "own", "band", "node", "component", "n", "sketch").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def judge(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, rep, comp, n = (group.column(c).to_numpy() for c in ("own", "node", "component", "n"))
        sketch = _matrix(group.column("sketch"))
        crossed = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        band = group.column("band")[0].as_py()
        earlier = sketch[:, : band * ROWS].reshape(len(sketch), band, ROWS)
        found = []
        for i in range(len(rep) - 1):
            j = np.arange(i + 1, len(rep))
            j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent) & ((own[j] != own[i]) == crossed)]
            if len(j) and band:
                j = j[~(earlier[j] == earlier[i]).all(axis=2).any(axis=1)]
            if len(j):
                j = j[(sketch[j] == sketch[i]).sum(axis=1) >= low * REGISTERS]  # registers agree more often than the sets do
            if len(j):
                e = estimate(np.broadcast_to(sketch[i], (len(j), REGISTERS)), sketch[j], np.full(len(j), n[i]), n[j])
                good = e >= low
                found.append(np.stack([np.full(good.sum(), i), j[good], (e[good] * 1000).astype(np.int64)]))
        if found:
            i, j, e = np.concatenate(found, axis=1)
            if best_only:
                x, y = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
                order = np.lexsort((-e, y, x))
                x, y = x[order], y[order]
                first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(order)]
                i, j = i[order][first], j[order][first]
            yield np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            marks = np.stack([held.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist()]
            yield from out(held, edges)
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from out(held, [0, held.num_rows])

    def out(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        found = [pair for s, e in zip(edges, edges[1:], strict=False) for pair in judge(table.slice(s, e - s))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): documents linked at a similarity of ``percent`` hundredths or more, in components."""
    return verdicts(docs, percent).drop("tk")


def verdicts(docs: DataFrame, percent: int) -> DataFrame:
    """Those rows with tk, the hash of the text."""
    ready(docs.sparkSession)
    with scratch():
        return cut(_near_duplicates(docs, percent), "neardup", result=True)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    sketched = cut(sketch_documents(docs), "sketch")
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumnRenamed("n_shingles", "n").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = cut(classes.withColumn("node", node()), "classes")
    keys = F.array(*(F.xxhash64(F.substring("sketch", i * ROWS + 1, ROWS), F.lit(i)) for i in range(BANDS)))
    banded = classes.select("node", "rep", "n", F.posexplode(keys).alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("rep", "node", "n")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = cut(banded.join(buckets, "key").select("key", "band", "node", "n", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"), "size"), "members")
    pairs = members.where((F.col("node") != F.col("leader")) & _sizes_allow("n", "leader_n", percent)).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    links = cut(confirm(likely(pairs, classes, percent), classes, docs, percent), "links")
    found = cut(components(links), "components")

    judged = pairs
    for best_only in (True, False):
        open_ = cut(members.where("size > 2").join(found, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component")), "open")
        more = cut(crossing(open_, classes, percent, best_only), "crossing")
        if more.isEmpty():
            break  # no two components share a bucket and look alike
        fresh = cut(confirm(more.join(judged, ["a", "b"], "left_anti"), classes, docs, percent), "links")
        judged = judged.union(more)
        if not fresh.isEmpty():
            links = links.union(fresh)
            found = cut(components(links), "components")

    known = classes.select("s1", "s2", F.col("n").alias("n_shingles"), "rep", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(names, "component").select("s1", "s2", "n_shingles", "component_id")
    out = sketched.select("doc_id", "tk", "n_shingles", "s1", "s2").join(known, ["s1", "s2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "tk", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less all but one of each component. The ids that go are broadcast up to BROADCAST_IDS of them."""
    gone = verdicts(docs, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("tk").alias("gone_tk")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # in one column, so that no name of theirs clashes
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.xxhash64(F.col("text").cast("binary")).alias("row_tk"))
    same = (F.col("row.doc_id").cast("long") == F.col("gone_id")) & (F.col("row_tk") == F.col("gone_tk"))
    return rows.join(gone, same, "left_anti").select("row.*")
