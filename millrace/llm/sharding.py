"""Sharding: minimax contiguous partition of ordered, atomic groups of equal texts into byte-balanced shards.

Groups (equal texts) are ordered by a 64-bit hash of the text. Their sizes, summed by the top bits of the
hash, reach the driver as a histogram of at most 2 ** BITS sums whatever the input. The smallest capacity
for which a greedy sweep needs no more than the wanted shards is found by binary search: the histogram
narrows the capacity, and only the few histogram cells that a cut can fall into are opened to single groups,
at most OPEN_CELLS at a time and from the first shard on, as what a shard ends with settles where the next
one starts (cells are split further on the cluster while they hold more than OPEN_GROUPS groups). Within that
capacity a second binary search finds the largest size that every shard can have, so a large group leaves no shard
empty. The cuts are hash values, so placing a row is a comparison, without a join. Law: ``bytes``.

Slots are numbered without a sort of a whole shard: rows are dealt to (shard, lane) by a hash of the id,
and of the text, numbered there, and shifted by the counts of the lanes before.

Defined results: a null text counts as empty (size 1, crc32 0) and shares the group of empty texts; texts of
any length are groups like others (texts whose 64-bit hashes agree share one); ids may
repeat or be null; extra columns are ignored; an empty table gives no rows; with fewer groups than shards
some shards stay empty. A group never splits, so one larger than the mean sets the capacity.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, scratch

BITS = 16
OPEN_GROUPS = 200_000
OPEN_CELLS = 256
WIDEST_CELLS = 16
LANES = 512


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Positions after which to cut so that no shard exceeds ``capacity``, or None. ``ends`` are running sums of positive sizes."""
    cuts, done, at = [], 0, 0
    for _ in range(shards):
        nxt = bisect_right(ends, done + capacity, lo=at)
        if nxt == at and at < len(ends):
            return None
        cuts.append(nxt)
        at, done = nxt, ends[nxt - 1] if nxt else 0
        if at == len(ends):
            return cuts
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of a contiguous partition and its greedy cuts."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    if not sizes:
        return 0, []
    low, high = max(max(sizes), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy_cuts(ends, low, shards)


def _ends(before: np.ndarray, shards: int, least: int, most: int) -> list[np.ndarray]:
    """For k = 0 .. shards: whether k shards of ``least`` to ``most`` each can hold all from a position on; ``before``: sums up to each position."""
    held = [np.arange(len(before)) == len(before) - 1]
    low, high = np.searchsorted(before, before + least, "left"), np.searchsorted(before, before + most, "right")
    for _ in range(shards):
        upto = np.concatenate([[0], np.cumsum(held[-1])])
        held.append(upto[high] > upto[np.minimum(low, high)])
    return held


def balanced_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts of a feasible ``capacity`` whose smallest shard is as large as it can be (found by binary search), each as near as these bounds allow to an equal part of what the shards before left."""
    before = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
    low, high = 0, int(before[-1]) // shards
    while low < high:
        mid = (low + high + 1) // 2
        if _ends(before, shards, mid, capacity)[shards][0]:
            low = mid
        else:
            high = mid - 1
    held, cuts, at = _ends(before, shards, low, capacity), [], 0
    for left in range(shards, 0, -1):
        a, b = np.searchsorted(before, before[at] + low, "left"), np.searchsorted(before, before[at] + capacity, "right")
        open_ = a + np.flatnonzero(held[left - 1][a:b])
        goal = before[at] + (before[-1] - before[at]) / left
        at = int(open_[np.argmin(np.abs(before[open_] - goal))])
        cuts.append(at)
    return cuts


def _open_cells(cells: list[tuple[int, int, int, int]], shards: int) -> list[int]:
    """Some of the cells (lo, size, groups, largest) of several groups that a cut can fall into, at any capacity between a lower bound and a feasible one; none only if there are none."""
    total, ends = 0, []
    for c in cells:
        total += c[1]
        ends.append(total)
    low = max(-(-total // shards), max(c[3] for c in cells))
    high, _ = minimax_cuts([c[1] for c in cells], shards)  # whole cells: feasible, so an upper bound
    found: list[int] = []
    first = last = 0  # bounds of where shard k ends, as sums
    for _ in range(shards):
        i = bisect_right(ends, first + low)
        j = bisect_right(ends, last + high)
        several = [k for k in range(i, min(j + 1, len(cells))) if cells[k][2] > 1]
        found += several
        if i >= len(cells) or len(found) > OPEN_CELLS:
            break
        # a shard ends before a single group that it can't hold, and somewhere inside a cell of several
        first = ends[i - 1] if i else 0
        last = total if j >= len(cells) else last + high if cells[j][2] > 1 else ends[j - 1] if j else 0
    if len(found) > OPEN_CELLS:  # a cell that holds a very large group widens the bounds
        found = found[:OPEN_CELLS] + sorted((k for k, c in enumerate(cells) if c[2] > 1), key=lambda k: -cells[k][1])[:WIDEST_CELLS]
    return sorted(set(found))


def plan_shards(groups: DataFrame, shards: int) -> list[int]:
    """Upper bounds (inclusive, signed 64-bit order) of the order key for shards 0 .. shards - 2. ``groups``: rows (key long, size long), one per row of data."""
    with scratch():
        return _plan_shards(cut(groups.groupBy("key").agg(F.sum("size").alias("size")), "groups"), shards)


def _plan_shards(groups: DataFrame, shards: int) -> list[int]:
    shift = 64 - BITS
    by_cell = groups.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
    cells = sorted(tuple(r) for r in by_cell.collect())  # at most 2 ** BITS rows
    if not cells:
        return []
    items = [(c << shift, size, n, most, shift) for c, size, n, most in cells]  # (lowest key, size, groups, largest, bits below)
    while todo := _open_cells([i[:4] for i in items], shards):
        bits = max(items[k][4] for k in todo)
        todo = [k for k in todo if items[k][4] == bits]
        held = sum(items[k][2] for k in todo)
        below = 0 if held <= OPEN_GROUPS else max(0, bits - 8)
        rows = groups.where(F.shiftright("key", bits).isin([items[k][0] >> bits for k in todo]))
        rows = rows.groupBy(F.shiftright("key", below).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
        opened = [(c << below, size, n, most, below) for c, size, n, most in rows.collect()]  # at most OPEN_GROUPS, or 256 for each of the cells
        gone = set(todo)
        items = sorted([i for k, i in enumerate(items) if k not in gone] + opened)
    sizes = [i[1] for i in items]
    cuts = balanced_cuts(sizes, shards, minimax_cuts(sizes, shards)[0])
    last = 2**63 - 1
    return [(items[c][0] - 1 if c < len(items) else last) for c in cuts[: shards - 1]]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard): whole groups of equal texts in byte-balanced shards."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    bounds = plan_shards(rows.select("key", "size"), shards)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + F.when(F.col("key") > b, 1).otherwise(0)
    lane = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("key"), F.lit("lane")), F.lit(LANES)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), lane.alias("lane"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    here = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(here) - 1)
    out = numbered.join(F.broadcast(lanes), ["shard", "lane"])  # at most shards x LANES rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
