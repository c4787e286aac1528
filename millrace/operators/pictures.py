"""Similar pictures by 64-bit hashes of thumbnails: multi-index hashing, then the tolerance test on the thumbnails."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import cut

BITS = 64
#: Values of a thumbnail (from 1) by which hashes are told apart before thumbnails meet.
POINTS = (4, 12, 20, 29, 36, 44, 52, 60)


def average_hash(thumb: Column) -> Column:
    """A long: bit i (the first is the highest) tells whether value i of a thumbnail of 64 values exceeds their mean. Null for null or for another number of values."""
    total = F.aggregate(thumb, F.lit(0).cast("long"), lambda s, v: s + v)
    bits = F.aggregate(thumb, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v * BITS > total).cast("long")))
    return F.when(F.size(thumb) == BITS, bits)


def _edges(radius: int, agree: int) -> list[int]:
    return [BITS * i // (radius + agree) for i in range(radius + agree + 1)]


def _keys(hash_: Column, radius: int, agree: int) -> Column:
    """Array of (combination, bits): radius + agree bands of the hash, any ``agree`` of them together. Hashes within the radius differ in at most ``radius`` bands, so they have a key in common."""
    parts, edges = radius + agree, _edges(radius, agree)
    bands = [F.shiftrightunsigned(hash_, BITS - b).bitwiseAND((1 << (b - a)) - 1) if b - a < BITS else hash_ for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(parts), agree)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(bands[i])
        keys.append(F.struct(F.lit(number).alias("comb"), key.alias("bits")))
    return F.array(*keys)


def _first_key(differ: Column, radius: int, agree: int) -> Column:
    """The first combination that two hashes have in common, given the bits in which they differ."""
    edges = _edges(radius, agree)
    masks = [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(edges, edges[1:], strict=False)]
    found = []
    for number, chosen in enumerate(combinations(range(radius + agree), agree)):
        mask = sum(masks[i] for i in chosen)
        found.append(F.when(differ.bitwiseAND(mask - 2**BITS if mask >> (BITS - 1) else mask) == 0, number))
    return F.coalesce(*found)


def _packed(values: list[Column]) -> Column:
    """A long of the values at POINTS, a byte each, cut off at 0 and 255."""
    out = F.lit(0).cast("long")
    for v in values:
        out = F.shiftleft(out, 8).bitwiseOR(F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("long"))
    return out


def _boxes_meet(low_a: str, high_a: str, low_b: str, high_b: str, tolerance: int) -> Column:
    """Whether thumbnails of two boxes of packed values can lie within the tolerance."""
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(255)
    meet = F.lit(True)
    for i in range(len(POINTS)):
        meet = meet & (byte(low_a, i) <= byte(high_b, i) + tolerance) & (byte(low_b, i) <= byte(high_a, i) + tolerance)
    return meet


def _cells(thumb: Column, width: int) -> list[Column]:
    """Cells of a grid in three values of a thumbnail: thumbnails within a tolerance below ``width`` lie in the same or in neighbouring cells."""
    return [F.floor(F.element_at(thumb, i) / width).cast("int") for i in (10, 28, 55)]


def near_counts(pictures: DataFrame, radius: int = 4, agree: int = 2, tolerance: int = 5) -> DataFrame:
    """Rows (id, class_id, n_near, n_close) of rows (id, thumb): the smallest id of an equal thumbnail; how many other pictures' hashes differ in at most ``radius`` bits; and how many of these have no value that differs by more than ``tolerance``. Null thumbnails take no part.

    Exact: the keys of two hashes within the radius meet, and they are paired at the first key that they share. Equal
    thumbnails are one class and equal hashes one row. Pairs are added up where they meet, so no row of each travels;
    only those whose boxes of values leave room for close thumbnails are kept. Their classes are compared value by
    value, those of a hash that several share in neighbouring cells of a grid only.
    """
    rows = cut(pictures.where(F.size("thumb") == BITS).select("id", "thumb"), "thumbs", result=True)
    classes = rows.groupBy("thumb").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    classes = cut(classes.withColumns({"hash": average_hash(F.col("thumb")), "class": F.monotonically_increasing_id()}), "classes", result=True)
    values = [F.element_at("thumb", i) for i in POINTS]
    hashes = classes.groupBy("hash").agg(F.sum("members").alias("members"), (F.count("*") > 1).alias("several"), _packed([F.min(v) for v in values]).alias("low"), _packed([F.max(v) for v in values]).alias("high"))
    hashes = cut(hashes, "hashes", result=True)
    keyed = cut(hashes.withColumn("k", F.explode(_keys(F.col("hash"), radius, agree))).select("k.comb", "k.bits", *hashes.columns), "keyed", result=True)
    a, b = (keyed.select("comb", "bits", *(F.col(c).alias(f"{c}_{x}") for c in hashes.columns)) for x in "ab")
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    met = a.join(b, ["comb", "bits"]).where((F.col("hash_a") < F.col("hash_b")) & (F.bit_count(differ) <= radius) & (F.col("comb") == _first_key(differ, radius, agree)))
    # a pair counts for both; the one with several classes, if any, is named as the other where they may be close
    swap = F.col("several_a") & ~F.col("several_b")
    x, y = (F.struct(F.col(f"hash_{x}").alias("hash"), F.col(f"members_{x}").alias("n")) for x in "ab")
    ways = met.select(F.when(swap, y).otherwise(x).alias("x"), F.when(swap, x).otherwise(y).alias("y"), (F.col("several_a") | F.col("several_b")).alias("several"), _boxes_meet("low_a", "high_a", "low_b", "high_b", tolerance).alias("meet"))
    other, several = F.when(F.col("meet"), F.col("y.hash")), F.col("meet") & F.col("several")
    ways = ways.select(F.inline(F.array(F.struct(F.col("x.hash").alias("hash"), other.alias("other"), several.alias("several"), F.col("y.n").alias("n")), F.struct(F.col("y.hash").alias("hash"), F.lit(None).cast("long").alias("other"), F.lit(False).alias("several"), F.col("x.n").alias("n")))))
    near = cut(ways.groupBy("hash", "other", "several").agg(F.sum("n").alias("n")), "near", result=True)
    n_near = near.groupBy("hash").agg(F.sum("n").alias("near"))
    meeting = near.where("other IS NOT NULL").select(F.col("hash").alias("x"), F.col("other").alias("y"), "several").union(hashes.where("several").select("hash", "hash", "several"))
    width = tolerance + 1
    left = classes.select(F.col("hash").alias("x"), F.col("class").alias("p"), F.col("thumb").alias("t_p"), F.col("members").alias("n_p"))
    right = classes.select(F.col("hash").alias("y"), F.col("class").alias("q"), F.col("thumb").alias("t_q"), F.col("members").alias("n_q"))
    sides = meeting.join(left, "x")
    single = sides.where(~F.col("several")).join(right, "y")
    grid = sides.where("several").withColumn("c", F.array(*_cells(F.col("t_p"), width)))
    for i in range(3):
        grid = grid.withColumn(f"c{i}", F.explode(F.array(*(F.col("c")[i] + d for d in (-1, 0, 1)))))
    shared = grid.drop("c").join(right.withColumns({f"c{i}": c for i, c in enumerate(_cells(F.col("t_q"), width))}), ["y", "c0", "c1", "c2"]).where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    close = F.forall(F.zip_with("t_p", "t_q", lambda u, v: F.abs(u - v)), lambda d: d <= tolerance)
    pairs = single.select("p", "q", "n_p", "n_q", "t_p", "t_q").union(shared.select("p", "q", "n_p", "n_q", "t_p", "t_q")).where(close)
    pairs = pairs.select(F.inline(F.array(F.struct(F.col("p").alias("class"), F.col("n_q").alias("n")), F.struct(F.col("q").alias("class"), F.col("n_p").alias("n")))))
    n_close = pairs.groupBy("class").agg(F.sum("n").alias("close"))
    found = classes.join(hashes.select("hash", F.col("members").alias("equal")), "hash").join(n_near, "hash", "left").join(n_close, "class", "left")
    counts = [(F.col(c) - 1 + F.coalesce(more, F.lit(0))).alias(n) for c, more, n in (("equal", "near", "n_near"), ("members", "close", "n_close"))]
    return rows.join(found.select("thumb", F.col("rep").alias("class_id"), *counts), "thumb").select("id", "class_id", "n_near", "n_close")
