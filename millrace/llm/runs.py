"""Periodic runs of words by Karp, Miller and Rosenberg's names of powers of two.

Words are named by numbers, and a stretch of 2 ** (k + 1) words by the rank of the pair of names of its halves, so two
stretches of that length are equal exactly if their names are. The longest common extension of two places, forward or
backward, descends the levels of names: where those of a level agree, both places move on by its length. A run of
period p has at least LEAST * p words, so it holds a place on the grid of (LEAST - 1) * p whose word recurs p further
on; each such place is extended both ways, and what it covers is a run if it is long enough. Whoever covers the same
stretch with a larger period covers a multiple, so the smallest one is the run's. All of it runs in numpy on about
FLUSH_WORDS words at a time, whole documents with a word of its own behind each. Stretches that occur once need no
name at the levels above, so the levels end with the longest repetition.

Defined results: a null text, or one without words, has no words, no runs and an empty collapsed text; texts of any
length count whole; repeated rows and null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ready, tidy

LEAST = 4
SHORTEST = 6
FLUSH_WORDS = 200_000
CANDIDATES = 1_000_000
BLANK = "[\\x20\\x09-\\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


def names(words: np.ndarray, repeated: np.ndarray) -> list[np.ndarray]:
    """For each level k the names of the stretches of 2 ** k words, equal exactly if the stretches are; ``repeated`` tells which words' names may occur twice."""
    levels, half = [words], 1
    while True:
        last = levels[-1]
        places = np.flatnonzero(repeated[: len(repeated) - half] & repeated[half:]) if len(repeated) > half else np.zeros(0, np.int64)
        if not len(places):
            return levels
        pairs = last[places] * (int(last.max()) + 1) + last[places + half]
        ranked, back, count = np.unique(pairs, return_inverse=True, return_counts=True)
        again = count[back] > 1
        if not again.any():
            return levels
        places, back = places[again], back[again]
        name = np.arange(len(last) - half, dtype=np.int64) + len(ranked)
        name[places] = back
        repeated = np.zeros(len(name), bool)
        repeated[places] = True
        levels.append(name)
        half *= 2


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places i < j: how many words from them on agree, and how many before them."""
    on, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, step = levels[k], 1 << k
        a, b = i + on, j + on
        ok = b < len(name)
        ok[ok] = name[a[ok]] == name[b[ok]]
        on[ok] += step
        a, b = i - back - step, j - back - step
        ok = a >= 0
        ok[ok] = name[a[ok]] == name[b[ok]]
        back[ok] += step
    return on, back


def _least(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a stretch, with its smallest period, in the order of starts and periods."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the texts that start at ``starts`` and have ``sizes`` words, each with a word of its own behind it."""
    levels = names(words, repeated)
    most = np.where(sizes >= SHORTEST, sizes // LEAST, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = (LEAST - 1) * period
    many = -(-(sizes[text] - period) // grid)
    ends = np.cumsum(many)
    found = [(np.zeros(0, np.int64),) * 3]
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        n = many[at:to]
        which = np.repeat(np.arange(at, to), n)
        i = starts[text[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * grid[which]
        p = period[which]
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        on, back = extend(levels, i, i + p)
        length = on + back + p
        long_ = length >= np.maximum(SHORTEST, LEAST * p)
        found.append(_least((i - back)[long_], length[long_], p[long_]))
        at = to
    return _least(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _collapsed(texts: list[bytes | None]) -> tuple[list[list[tuple[int, int, int]]], list[int], list[bytes]]:
    """Of each text its runs, its number of words, and its words but those that a run repeats, joined by blanks."""
    split = [t.split() if t else [] for t in texts]  # bytes are split at the six blanks of ASCII
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    inner = np.ones(int(sizes.sum()) + len(split), bool)
    inner[starts + sizes] = False
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    words = np.empty(len(inner), np.int64)
    words[inner] = coded.indices.to_numpy()
    words[~inner] = len(coded.dictionary) + np.arange(len(split))
    count = np.bincount(words, minlength=1)
    start, length, period = find(words, starts, sizes, count[words] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    gone = np.cumsum(step)[:-1] > 0
    text = np.searchsorted(starts, start, "right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for t, *run in zip(text.tolist(), (start - starts[text]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append(tuple(run))
    out = []
    for own, at, found in zip(split, starts.tolist(), runs, strict=True):
        if found:
            keep = ~gone[at : at + len(own)]
            own = [own[i] for i in np.flatnonzero(keep).tolist()]
        out.append(b" ".join(own))
    return runs, sizes.tolist(), out


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: the words that aren't in a run beyond its first period, joined by a blank each. Columns of these names are replaced."""
    ready(docs.sparkSession)
    added = T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")
    kept = [f for f in docs.schema.fields if f.name not in added.names]
    rows = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("_text"), *(docs[f"`{f.name}`"] for f in kept))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            bytes_ = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            group = np.cumsum(bytes_) // (FLUSH_WORDS * 6)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    runs, sizes, out = _collapsed(part.column(0).to_pylist())
                    found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind)
                    cols = [*part.columns[1:], pa.array(sizes, pa.int64()), found, pa.array(out, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[1:], *added.names])

    return rows.mapInArrow(tidy(run), T.StructType([*kept, *added.fields]))


def echoed(doc_id: Column, text: Column) -> Column:
    """The text, or for one in ten by a hash of the id its words with a period: from word a on, word i becomes word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    rows = F.struct(F.filter(F.split(text, BLANK), lambda w: w != "").alias("w"))

    def planted(x: Column) -> Column:
        w = x["w"]
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int")))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(text)

    # a transform over one element, so that the words are split once
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), F.get(F.transform(F.array(rows), planted), F.lit(0))).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of whole texts after ``echoed``: the number of runs, the one of the largest exponent, digests of all and of what is left."""
    found = collapse_runs(docs.select("doc_id", echoed(F.col("doc_id"), F.col("text").cast("string")).alias("text"))).select("doc_id", "runs", "collapsed")
    # different quotients a / b and c / d differ by a part of 1 / (b * c) at least, which doubles tell below 2 ** 26 words
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("q"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("r")))
    best = F.array_max(ranked)["r"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
