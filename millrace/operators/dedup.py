"""Duplicates by content and by similarity of word sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions.lineage import cut as saved

PARITY_LONGS = 8
#: Bytes of the table of word frequencies, which is broadcast, and those of it that one task fills at once.
SLOTS, CHUNK = 1 << 24, 1 << 16
#: Ids of texts to compare that are broadcast; more are joined.
BROADCAST_IDS = 2_000_000


def duplicate_report(df: DataFrame, group: str, content: Column, order: str, cap: int) -> DataFrame:
    """A row for each content that repeats within its group: rank by copies, number, first row, rows beyond the cap, preview."""
    rows = df.groupBy(F.col(group), F.md5(content).alias("hash")).agg(F.count("*").alias("copies"), F.min(order).alias("first_id"), F.min(F.substring(content, 1, 120)).alias("preview")).where("copies > 1")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("copies"), "first_id"))
    return rows.select(group, rank.alias("rank"), "copies", "first_id", (F.col("copies") - F.least("copies", F.lit(cap))).alias("removed"), "preview")


def word_sets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, set): distinct words of each text, sorted; texts without words take no part."""
    return df.where(X.nonblank(F.col(text_col))).select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(X.words(F.col(text_col)))).alias("set"))


def _key(words: Column) -> Column:
    """A 128-bit hash of a set."""
    return F.md5(F.array_join(words, "\n"))


def frequency_levels(sets: DataFrame) -> np.ndarray:
    """For each of SLOTS values of a word's hash, a level of how many sets have one of its words: 1 only where one set has, and a quarter more at least from level to level. Of a fixed size, whatever the number of words."""
    words = sets.select(F.explode("set").alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.count("*").alias("n"))

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        out, n = np.zeros(CHUNK, np.uint8), rows["n"].to_numpy()
        out[rows["slot"].to_numpy() % CHUNK] = np.where(n < 2, 1, np.minimum(2 + np.floor(3 * np.log2(np.maximum(n, 2) / 2)), 255))
        return pd.DataFrame({"chunk": [int(rows["slot"].iloc[0] // CHUNK)], "levels": [out.tobytes()]})

    found = np.zeros(SLOTS, np.uint8)
    chunks = counts.groupBy(F.floor(F.col("slot") / CHUNK)).applyInPandas(levels, "chunk long, levels binary")
    for row in chunks.toLocalIterator():  # SLOTS bytes in all
        found[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["levels"], np.uint8)
    return found


def profiles(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, key, n, skip, prefix, bits) of each set, as a table: its hash and size; hashes of its first n - ceil(n * num / den) + 1 words in the order of (level, hash), less the first ``skip``, which no other set has; and its parity, a bitmap of 64 * PARITY_LONGS bits in which each word flips the bit of its hash. Two bitmaps differ in no more bits than their sets in words."""
    level = sets.sparkSession.sparkContext.broadcast(frequency_levels(sets))
    size = 64 * PARITY_LONGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hashes = batch.column(2)
                n, w = hashes.value_lengths().to_numpy().astype(np.int64), hashes.flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                odd = np.bincount(row * size + (w & (size - 1)), minlength=len(n) * size) & 1
                bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                levels = level.value[w & (SLOTS - 1)]
                order = np.lexsort((w, levels, row))
                w, levels = w[order], levels[order]
                keep = n + (-n * num // den) + 1
                place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                chosen = (place < keep[row]) & (levels > 1)
                held = np.bincount(row[chosen], minlength=len(n))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32()), pa.array(v, pa.int64())) for x, v in ((held, w[chosen]), (np.full(len(n), PARITY_LONGS), bits))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(keep - held, pa.int32()), *lists], ["id", "key", "n", "skip", "prefix", "bits"])

    # of a set that is made once, as both the key and the hashes read it
    both = X.once(F.col("set"), lambda x: F.struct(_key(x).alias("key"), F.transform(x, lambda w: F.xxhash64(w)).alias("hashes")))
    rows = sets.select("id", both.alias("s")).select("id", "s.key", "s.hashes")
    kind = sets.schema["id"].dataType.simpleString()
    return saved(rows.mapInArrow(run, f"id {kind}, key string, n int, skip int, prefix array<long>, bits array<long>"), "profiles")


def _differ(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def similar_classes(df: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of texts (doc_id, text). Rows (id, key, n): a hash of each text's set of words and its size. Equal sets form a class (key, rep, n, members); links (a, b) are classes with Jaccard similarity of at least num / den.

    Exact by filters that lose no link. Prefix: with words in any one order, two similar sets share a word among the
    first n - ceil(n * num / den) + 1; in the order of rarity, only rare words are joined on. How rare a word is, is
    looked up in a table of a fixed size, so that words don't travel. Sizes: similar sets lie in the
    same or in neighbouring classes of sizes, which are part of the key, so a word that many prefixes have is split.
    Position: the words left after a shared one bound the overlap. Parity: bitmaps that differ in too many bits
    belong to sets that do; two longs of them are looked at before pairs travel. Only what is left after all four is
    compared word by word, for which the sets are made again, of these texts only.
    """
    sets = word_sets(df)
    rows = profiles(sets, num, den)
    classes = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("n", "skip", "prefix", "bits")))
    classes = saved(classes, "classes")
    fold = [F.reduce(F.transform(F.sequence(F.lit(i), F.lit(PARITY_LONGS - 1), F.lit(2)), lambda j: F.get("bits", j)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"f{i}") for i in range(2)]
    prefix = classes.select("rep", "n", "skip", *fold, F.posexplode("prefix").alias("at", "w"))
    # sizes n <= m of similar sets have n * den >= m * num; a class spans that ratio, so m's is n's or the next
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) - 1e-9) if num < den else n.cast("long")
    prefix = saved(prefix.select("rep", "n", (F.col("n") - F.col("skip") - F.col("at")).alias("left"), "w", "f0", "f1"), "prefix")
    b = prefix.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.xxhash64("w", size_class(F.col("n"))).alias("k"), F.col("f0").alias("f0_b"), F.col("f1").alias("f1_b"))
    reach = F.sequence(size_class(F.col("n")), size_class(F.floor(F.col("n") * den / num)))
    a = prefix.withColumn("c", F.explode(reach)).select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.xxhash64("w", "c").alias("k"), F.col("f0").alias("f0_a"), F.col("f1").alias("f1_a"))
    fits = (F.col("n_a") <= F.col("n_b")) & ((F.col("n_a") < F.col("n_b")) | (F.col("a") < F.col("b"))) & (F.col("n_a") * den >= F.col("n_b") * num)
    # an overlap of k words in n_a + n_b is similar enough if k * (num + den) >= (n_a + n_b) * num
    enough = F.least("left_a", "left_b") * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    most = (F.col("n_a") + F.col("n_b")) * (den - num)
    folds = [[F.col(f"f{i}_{x}") for i in range(2)] for x in "ab"]
    pairs = a.join(b, "k").where(fits & enough & (_differ(*folds) * (num + den) <= most)).select("a", "b", "n_a", "n_b").distinct()
    bits_a, bits_b = (classes.select(F.col("rep").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    every = [[F.get(f"bits_{x}", F.lit(i)) for i in range(PARITY_LONGS)] for x in "ab"]
    pairs = saved(pairs.join(bits_a, "a").join(bits_b, "b").where(_differ(*every) * (num + den) <= most).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = saved(classes.select("rep", "key").join(wanted, "rep"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    again = sets.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "set", _key(F.col("set")).alias("key"))
    again = saved(again.join(wanted, (F.col("id") == F.col("rep")) & (again["key"] == wanted["key"])).select("rep", "set"), "sets")
    left, right = (again.select(F.col("rep").alias(x), F.col("set").alias(f"s_{x}")) for x in "ab")
    same = F.size(F.array_intersect("s_a", "s_b"))
    links = pairs.join(left, "a").join(right, "b").where(same * den >= (F.size("s_a") + F.size("s_b") - same) * num)
    return rows.select("id", "key", "n"), classes.select("key", "rep", "n", "members"), links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(df: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (doc_id, n_tokens, class_id, n_links): links of a document to all others; those within its class count too."""
    rows, classes, links = similar_classes(df, num, den)
    links = saved(links, "links")
    sizes = classes.select("rep", "members")
    both = links.select(F.col("a").alias("x"), F.col("b").alias("rep")).union(links.select(F.col("b").alias("x"), F.col("a").alias("rep")))
    outside = both.join(sizes, "rep").groupBy("x").agg(F.sum("members").alias("outside"))
    per_class = classes.join(outside, classes["rep"] == outside["x"], "left").select("key", "rep", (F.col("members") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    return rows.join(per_class, "key").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_tokens"), F.col("rep").alias("class_id"), "n_links")


def losers(links: DataFrame) -> list[DataFrame]:
    """Tables (x) of those that go if, in order, each is kept unless it has a link (a, b), a < b, to one kept before.

    In rounds over the links: one without an undecided or kept smaller neighbour is kept, and the larger neighbours of
    kept ones go. Every round decides the smallest undecided one of each connected part at least.
    """
    open_, gone = links, []
    while not open_.isEmpty():
        larger = open_.select(F.col("b").alias("x")).distinct()
        kept = open_.select(F.col("a").alias("x")).distinct().join(larger, "x", "left_anti")
        out = saved(open_.join(kept, open_["a"] == kept["x"], "left_semi").select(F.col("b").alias("x")).distinct(), "out")
        gone.append(out)
        left = open_.join(kept, open_["a"] == kept["x"], "left_anti")
        left = left.join(out, left["a"] == out["x"], "left_anti").join(out, F.col("b") == out["x"], "left_anti")
        open_ = saved(left, "links")
    return gone


def greedy_keep_first(df: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (doc_id, kept): in order of ids a document is kept unless it is similar to one kept before."""
    rows, classes, links = similar_classes(df, num, den)
    gone = losers(saved(links, "links"))
    decided = rows.join(classes.select("key", "rep"), "key").select(F.col("id").alias("doc_id"), "rep")
    if gone:
        decided = decided.join(reduce(DataFrame.union, gone).withColumnRenamed("x", "rep").withColumn("gone", F.lit(True)), "rep", "left")
    else:
        decided = decided.withColumn("gone", F.lit(None).cast("boolean"))
    return decided.select("doc_id", (F.col("gone").isNull() & (F.col("doc_id") == F.col("rep"))).alias("kept"))
