"""Near duplicates across the batches of a stream: what was kept is stored with the words it is found by, and every batch meets that store and extends it.

A row is dropped if it is similar to a row kept before it, of an earlier batch or of its own; so the flags are those of
one pass over all rows in the order of arrival, whatever the batches. A batch is one entry of the ledger, which holds
its rows' flags and, of the kept ones, sets of words and prefixes: a batch that runs again meets the same store.

Similar sets of sizes n <= m differ in few words, at most k of them. Words are dealt by their hash into more than k
parts, so at least one part is the same in both, and the parts' hashes are what sets are found by: some words together,
which few other sets have, as one word need not be. The number of parts goes by the class of the smaller size, so a set
has the parts of its own class and, where it is the larger one, of the class below. The rows of a batch meet each other
by the same keys. Words are made once a row; those of a stored row are read again only where a row of the batch shares
a key with it. A batch reads the keys of the store once, against a filter of fixed size of its own keys, so that only
those that are met travel; its cost is the store's keys a batch: choose large batches.
Rows without words, null texts among them, are kept; ids may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.lineage import cut, scratch
from millrace.operators import dedup
from millrace.streaming import ledger

STORED = "n long, id {}, kept boolean, words array<string>, prefix array<long>, batch string"
#: Longs of the filter of a batch's keys, which is broadcast, and those of it that one task fills at once; each key sets a bit of one long by each of these stretches of its own bits.
FILTER, CHUNK, BITS = 1 << 21, 1 << 13, (21, 27, 33, 39)
#: Rows with a shared key meet in pairs as long as there are so many pairs a key at most; beyond that the first row of each key goes ahead, for so many rounds.
PAIRS_A_KEY, ROUNDS = 4, 8


def parts_of(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set of words' hashes: similar sets have one in common."""
    out = []
    c = int(np.floor(np.log(len(hashes)) / np.log(den / num) - 1e-9)) if num < den else 0
    for scheme in (c, c - 1) if num < den else (c,):
        # similar sets, of which the smaller has at most so many words, differ in at most so many
        most = int(np.floor((den / num) ** (scheme + 1) * (1 + 1e-8))) if num < den else len(hashes)
        differ = (most + most * den // num) * (den - num) // (den + num)
        spare = differ // 8 + 1 if differ else 0
        parts = differ + 1 + spare
        place = (hashes % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, place, hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        held = np.bincount(place, minlength=parts)
        # at least spare + 1 parts agree, and in neither set more than spare have fewer words than its level: one is chosen in both
        chosen = np.flatnonzero(held >= np.sort(held)[spare])
        key = (sums[chosen] ^ (sums[chosen] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(key + chosen.astype(np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64((scheme + 1000) * 0xD6E8FEB86659FD93 % 2**64))
    return np.concatenate(out).view(np.int64)


def with_prefix(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Adds ``prefix``: the keys by one of which every similar set of ``words`` is found; null without words."""

    @F.pandas_udf("array<long>")
    def keys(hashes: pd.Series) -> pd.Series:
        return pd.Series([parts_of(np.asarray(h, np.int64).view(np.uint64), num, den) if len(h) else None for h in hashes], dtype=object)

    return sets.withColumn("prefix", keys(F.transform("words", lambda w: F.xxhash64(w))))


def key_filter(keys: DataFrame) -> np.ndarray:
    """FILTER longs in which every key ``k`` has its bits set. Of a fixed size, whatever the number of keys."""
    bits = F.lit(0).cast("long")
    for shift in BITS:
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("k", shift).bitwiseAND(63).cast("int")))
    longs = keys.groupBy(F.col("k").bitwiseAND(FILTER - 1).alias("at")).agg(F.bit_or(bits).alias("bits"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        out, at = np.zeros(CHUNK, np.int64), rows["at"].to_numpy()
        out[at % CHUNK] = rows["bits"].to_numpy()
        return pd.DataFrame({"chunk": [int(at[0] // CHUNK)], "bits": [out.tobytes()]})

    found = np.zeros(FILTER, np.int64)
    for row in longs.groupBy(F.floor(F.col("at") / CHUNK)).applyInPandas(fill, "chunk long, bits binary").collect():  # 8 * FILTER bytes in all
        found[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["bits"], np.int64)
    return found


def met_keys(store: DataFrame, held: Broadcast) -> DataFrame:
    """Rows (batch, n_b, k) of the stored rows' keys: all that the filter ``held`` was made of and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n, k = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            longs, met = held.value[k & (FILTER - 1)], np.ones(len(k), bool)
            for shift in BITS:
                met &= (longs >> ((k >> shift) & 63)) & 1 == 1
            row = pa.array(np.repeat(np.arange(len(n)), n)[met])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(k[met])], ["batch", "n_b", "k"])

    return store.where("prefix IS NOT NULL").select("batch", F.col("n").alias("n_b"), "prefix").mapInArrow(run, "batch string, n_b long, k long")


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose columns of ``ids``, a table, are among these; rows don't travel as long as the ids can."""
    return rows.join(F.broadcast(ids) if ids.count() <= dedup.BROADCAST_IDS else ids, ids.columns, "left_semi")


def _similar(num: int, den: int) -> Column:
    # same * den >= (a + b - same) * num, with the words in common made once
    same = F.size(F.array_intersect("words_a", "words_b"))
    return same * (num + den) >= (F.size("words_a") + F.size("words_b")) * num


def similar_to_stored(new: DataFrame, store: DataFrame, num: int, den: int) -> DataFrame:
    """The n of the rows (n, words, prefix) that are similar to one of the store's rows (batch, n, words, prefix)."""
    keys = new.select("n", F.explode("prefix").alias("k"))
    held = new.sparkSession.sparkContext.broadcast(key_filter(keys))
    pairs = cut(keys.join(met_keys(store, held), "k").select("n", "batch", "n_b").distinct(), "pairs")
    held.destroy()
    old = store.select("batch", F.col("n").alias("n_b"), F.col("words").alias("words_b"))
    old = cut(_among(old, cut(pairs.select("batch", "n_b").distinct(), "ids")), "met")
    ours = cut(_among(new.select("n", F.col("words").alias("words_a")), cut(pairs.select("n").distinct(), "ids")), "ours")
    return pairs.join(ours, "n").join(old, ["batch", "n_b"]).where(_similar(num, den)).select("n").distinct()


def links_of(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of numbers whose rows (n, words) are similar, as a table."""
    words = cut(_among(rows.select("n", "words"), cut(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "ids")), "words")
    a, b = (words.select(F.col("n").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    return cut(pairs.join(a, "a").join(b, "b").where(_similar(num, den)).select("a", "b"), "links")


def similar_to_earlier(rows: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Tables (x) of the n of the rows (n, words, prefix), all of different words, that are similar to a row kept before them.

    Every row meets the first one with its key. A first row of all its keys has met every row that may be similar: it is
    kept, and those similar to it go. So a large group of near copies ends in few rounds without all of its pairs; what
    is left then meets in pairs.
    """
    keys = rows.select("n", F.explode("prefix").alias("k"))
    shared = cut(keys.groupBy("k").agg(F.min("n").alias("first"), F.count("*").alias("c")).where("c > 1"), "shared")
    left, gone = cut(keys.join(shared.select("k"), "k"), "left"), []
    for _ in range(ROUNDS):
        count = shared.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.expr("c * (c - 1) / 2")), F.lit(0))).first()
        if count[1] <= PAIRS_A_KEY * count[0]:
            break
        met = left.join(shared, "k")
        firsts = cut(met.groupBy("n").agg(F.bool_and(F.col("n") == F.col("first")).alias("kept")).where("kept").select("n"), "firsts")
        pairs = met.where("n <> first").select(F.col("first").alias("a"), F.col("n").alias("b"))
        pairs = cut(pairs.join(firsts, F.col("a") == firsts["n"], "left_semi").distinct(), "pairs")
        out = cut(links_of(pairs, rows, num, den).select(F.col("b").alias("x")).distinct(), "out")
        gone.append(out)
        left = cut(left.join(firsts.union(out).withColumnRenamed("n", "x"), F.col("n") == F.col("x"), "left_anti"), "left")
        shared = cut(left.groupBy("k").agg(F.min("n").alias("first"), F.count("*").alias("c")).where("c > 1"), "shared")
    a, b = (left.select("k", F.col("n").alias(x)) for x in "ab")
    pairs = cut(a.join(b, "k").where("a < b").select("a", "b").distinct(), "pairs")
    return gone + dedup.losers(links_of(pairs, rows, num, den))


def flagged(rows: DataFrame, store: DataFrame | None, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """Rows (n, id, kept, words, prefix) of a batch; n numbers them as they came."""
    found = rows.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = F.sort_array(F.array_distinct(X.words(F.col("text"))))
    found = found.select("n", "id", F.when(X.nonblank(F.col("text")), words).otherwise(F.array().cast("array<string>")).alias("words"))
    found = cut(with_prefix(found, num, den), "batch")
    # of equal sets only the first can be kept
    firsts = cut(found.where(F.size("words") > 0).groupBy(F.md5(F.array_join("words", "\n")).alias("key")).agg(F.min("n").alias("n")).select("n"), "first")
    some, gone = _among(found, firsts), []
    if store is not None:
        gone = [cut(similar_to_stored(some, store, num, den).withColumnRenamed("n", "x"), "known")]
        some = some.join(gone[0], F.col("n") == F.col("x"), "left_anti")
    gone += similar_to_earlier(some, num, den)
    if gone:
        firsts = firsts.join(reduce(DataFrame.union, gone), F.col("n") == F.col("x"), "left_anti")
    kept = cut(firsts.withColumn("first", F.lit(True)), "kept")
    flags = found.join(F.broadcast(kept) if kept.count() <= dedup.BROADCAST_IDS else kept, "n", "left")
    with_flags = flags.withColumn("kept", F.col("first").isNotNull() | (F.size("words") == 0))
    return with_flags.select("n", "id", "kept", *(F.when(F.col("kept"), F.col(c)).alias(c) for c in ("words", "prefix")))


def keep_first(source: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", num: int = 9, den: int = 10) -> DataFrame:
    """Runs a bounded stream to its end; rows (id, kept) of all batches that ``out`` holds, those of earlier runs included. The store is Parquet; one of JSON lines, as it was once, is an error."""
    spark = source.sparkSession
    sink = ledger.Ledger(spark, out, "parquet")
    schema = STORED.format(source.schema[id_col].dataType.simpleString())

    def each(rows: DataFrame, key: str) -> None:
        if sink.has(key):
            return
        with scratch():
            store = sink.read(schema).where("kept AND prefix IS NOT NULL") if sink.folders() else None
            sink.append(flagged(rows, store, id_col, text_col, num, den).withColumn("batch", F.lit(key)), key)

    ledger.run(source, each, checkpoint)
    return sink.read(schema).select(F.col("id").alias(id_col), "kept")
