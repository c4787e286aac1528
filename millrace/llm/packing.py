"""Best-fit packing of tokenised documents into sequences of at most 2048 tokens, planned on the length histogram.

Lengths are integers up to the capacity, so the whole instance is a histogram of at most 2048 counts, whatever
the corpus size. On it, Martello-Toth dominance reduction first fixes sets that provably dominate every
alternative: a length that fits with nothing is alone; a length with an exact complement takes it; a length
that has room for at most one partner takes the largest. The rest is packed best-fit, longest first, with
whole runs of equal sequences moved at once. The plan is a list of runs (length, ranks, sequences, offset);
its size depends on the number of lengths only. Pieces are ranked within their length by (lane, id); a length
has a lane for every LANE_ROWS of its pieces, so no length is sorted in one task, and they look up their run.

Defined results: a null or empty text is the single closing token; texts of any length are encoded whole, those
with BLANKS or more blanks in a row by the library itself; documents longer than the capacity are cut
into full pieces of which the first may be shorter; equal documents may share a sequence; repeated rows are
packed once each; null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, ready, tidy

_BLANK = re.compile(r"\s+")
CAPACITY = 2048
LANE_ROWS = 100_000
BLANKS = 10_000
END_ID = 0


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others for code points from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """text -> numpy ids, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``. Where the merges are in the order of ids, as ranks need, the rank-based encoder of tiktoken does the work."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges, special = spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ordered = [vocab.get(a + b) for a, b in pairs]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    try:
        import tiktoken
    except ImportError:
        plain = False
    if plain and None not in ordered and all(a < b for a, b in zip(ordered, ordered[1:], strict=False)):
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level split
        coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)
        whole = library_encoder(path)

        def encode(text: str) -> np.ndarray:
            if len(text) >= BLANKS and max(map(len, _BLANK.findall(text)), default=0) >= BLANKS:
                return whole(text)  # the split's look-ahead would go back over the whole run
            return np.asarray(coder.encode_to_numpy(text, allowed_special=names, disallowed_special=()), "<u4")

        return encode
    return library_encoder(path)


def library_encoder(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document's token ids and the closing id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer_path)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                first = len(tokens) % capacity or capacity
                edges = [0, *range(min(first, len(tokens)), len(tokens), capacity), len(tokens)]
                for i in range(len(edges) - 1):
                    ids.append(doc_id.as_py())
                    piece.append(i)
                    start.append(edges[i])
                    length.append(edges[i + 1] - edges[i])
                    crc.append(zlib.crc32(tokens[edges[i] : edges[i + 1]].tobytes()))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, piece, start, length, crc), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Planner:
    """Packs a histogram {length: count}. ``runs``: (length, first rank, items, items a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: v for k, v in counts.items() if v}
        self.rank = dict.fromkeys(self.left, 0)
        self.sequences, self.runs = 0, []

    def _put(self, length: int, items: int, each: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], items, each, first, offset))
        self.rank[length] += items
        self.left[length] -= items

    def _smallest(self, taken: int, want: int) -> list[int]:
        """The ``want`` smallest lengths left beside one of ``taken``."""
        found = []
        for x in self.order:
            n = self.left[x] - (x == taken)
            found += [x] * min(n, want - len(found))
            if len(found) == want:
                break
        return found

    def reduce(self) -> int:
        """Dominance reduction until nothing more is fixed; the number of sequences fixed."""
        before, again = self.sequences, True
        while again:
            again = False
            self.order = sorted(k for k, v in self.left.items() if v)
            for a in reversed(self.order[:]):
                while self.left[a]:
                    self.order = [x for x in self.order if self.left[x]]
                    low = self._smallest(a, 2)
                    if not low or a + low[0] > self.capacity:
                        n = self.left[a] if a * 2 > self.capacity else 1
                        self._put(a, n, 1, self.sequences, 0)
                        self.sequences += n
                        again = True
                        continue
                    i = bisect_right(self.order, self.capacity - a) - 1
                    if self.order[i] == a and self.left[a] < 2:
                        i -= 1
                    k = self.order[i]
                    if a + k != self.capacity and (len(low) == 2 and a + sum(low) <= self.capacity):
                        break  # three could go together: nothing is proved
                    if a == k:
                        n = self.left[a] // 2
                        self._put(a, 2 * n, 2, self.sequences, 0)
                    else:
                        n = min(self.left[a], self.left[k])
                        self._put(a, n, 1, self.sequences, 0)
                        self._put(k, n, 1, self.sequences, a)
                    self.sequences += n
                    again = True
        return self.sequences - before

    def best_fit(self) -> None:
        """What is left, longest first, each item to the fullest sequence it fits."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
        rooms: list[int] = []

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, n))

        for a in sorted((k for k, v in self.left.items() if v), reverse=True):
            while self.left[a]:
                at = bisect_left(rooms, a)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-self.left[a] // (room // a))
                    self.sequences += n
                each = room // a
                full = min(n, self.left[a] // each)
                if full:
                    self._put(a, full * each, each, first, self.capacity - room)
                    keep(room - each * a, first, full)
                rest = min(self.left[a], each - 1) if full < n else 0
                if rest:
                    self._put(a, rest, rest, first + full, self.capacity - room)
                    keep(room - rest * a, first + full, 1)
                    full += 1
                keep(room, first + full, n - full)

    def plan(self) -> list[tuple[int, int, int, int, int, int]]:
        self.reduce()
        self.best_fit()
        return self.runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces", result=True)
    sizes = pieces.groupBy("length").count().collect()  # at most capacity rows
    lanes = spark.createDataFrame([(n, -(-c // LANE_ROWS)) for n, c in sizes], "length long, lanes long")
    pieces = pieces.join(F.broadcast(lanes), "length").withColumn("lane", F.pmod("deal", "lanes"))
    counts = pieces.groupBy("length", "lane").count().collect()  # a row for each length and LANE_ROWS pieces
    histogram: dict[int, int] = {}
    shifts = []
    for length, lane_, n in sorted(tuple(r) for r in counts):
        shifts.append((length, lane_, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    runs = Planner(histogram, capacity).plan()
    here = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(here) - 1)
    shift = spark.createDataFrame(shifts, "length long, lane long, shift long")
    run = spark.createDataFrame([(a, r, r + n, each, first, off) for a, r, n, each, first, off in runs], "length long, low long, high long, each long, first long, base long")
    ranked = ranked.join(F.broadcast(shift), ["length", "lane"]).withColumn("rank", F.col("at") + F.col("shift"))
    # the plan has a few runs a length; its size doesn't grow with the pieces
    placed = ranked.join(F.broadcast(run), (ranked["length"] == run["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(run["length"])
    step = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity), capacity)
