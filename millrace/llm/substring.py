"""Substring dedup: removes words covered by a window of WINDOW words that also starts in an earlier document.

The reference for a document is all documents with smaller ids, far too much to broadcast at scale. So the
reference is cut into shards that meet only what they can match, routed by anchors: in each window the
smallest hash of GRAM consecutive words (the leftmost) names an anchor, so equal windows have equal anchors.
Each maximal run of windows with one anchor is a context, and only contexts whose anchor occurs in several
distinct texts leave their document.

Equal contexts of an anchor form a class, told apart by a 128-bit hash of the words: the smallest id stands
for it, and the others lose the whole context. The classes of an anchor form a reference shard. In order of
ids they stream through a suffix automaton over words: matching statistics give every span of at least WINDOW
words that an earlier document holds, and then the document's own contexts are added to the automaton. A shard
of more than SHARD_WORDS words is cut into smaller ones by longer anchors, first of twice GRAM words, then of
the whole window; contexts whose new anchor occurs in one text only are done. Shards of whole windows hold one
class, so no shard outgrows a worker, however many documents share an anchor.

Equal texts are told apart by a 128-bit hash first: all but the smallest id lose every word if there are
WINDOW of them.

Defined results: words are runs of bytes other than blank and 0x09-0x0D, unchanged; a null or empty text has
no words; texts of any length are judged whole; windows are judged on the input; rows that repeat a document
keep one verdict and are each returned; rows with one id and different texts are each judged by the rows with
smaller ids, not by each other; rows without id lose nothing and are no reference; extra columns are ignored;
an empty table gives no rows. Anchors are 64-bit hashes, which only route; spans are found on the words.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ready, scratch, tidy

WINDOW = 50
GRAM = 12
SHARD_WORDS = 20_000
FLUSH_BYTES = 16_000_000
BROADCAST_IDS = 4_000_000

_rng = np.random.default_rng(11)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_keys(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
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
    return _mix(np.add.reduceat(inside, first) + size.astype(np.uint64))


def gram_keys(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j : len(total) + j] * _ORDER[j]
    return _mix(total)


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, first window, last window) of each maximal run of windows with one anchor key: in text that repeats itself, one long run."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = gram_keys(words, gram)
    span = window - gram + 1
    places = []
    for at in range(0, len(keys) - span + 1, 1 << 15):
        view = np.lib.stride_tricks.sliding_window_view(keys[at : at + (1 << 15) + span - 1], span)
        places.append(view.argmin(axis=1) + np.arange(at, at + len(view)))
    key = keys[np.concatenate(places)]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new].view(np.int64), new, np.append(new[1:], len(key)) - 1


class SuffixAutomaton:
    """Of several word sequences. A state's first move is kept in arrays, further ones in a dictionary."""

    def __init__(self):
        self.size, self.link = array("q", [0]), array("q", [-1])
        self.word, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}

    def step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(word, -1)

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, size: int) -> int:
        self.size.append(size)
        self.link.append(0)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        c = self._new(self.size[p] + 1)
        self.word[c], self.to[c], self.link[c] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        while p >= 0 and self.step(p, word) == q:
            self._set(p, word, c)
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            q = self.step(last, w)
            if q >= 0:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._new(self.size[last] + 1), last
            while p >= 0 and self.step(p, w) < 0:
                self._set(p, w, new)
                p = self.link[p]
            if p >= 0:
                q = self.step(p, w)
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
            last = new

    def spans(self, words: list[int], least: int) -> tuple[list[list[int]], int]:
        """Maximal [start, end) spans made of matches of at least ``least`` words, and how many windows of that size match."""
        out: list[list[int]] = []
        state = length = held = 0
        for i, w in enumerate(words):
            to = self.step(state, w)
            while to < 0 and state:
                state = self.link[state]
                length = self.size[state]
                to = self.step(state, w)
            if to >= 0:
                state, length = to, length + 1
            if length >= least:
                held += 1
                start = i + 1 - length
                if out and start <= out[-1][1]:
                    out[-1][0] = min(start, out[-1][0])
                    out[-1][1] = i + 1
                else:
                    out.append([start, i + 1])
        return out, held


def _profile(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each document: words, identity of the text, digest of all its words, anchors with their runs of windows."""
    schema = "doc_id long, tk long, n_words long, k1 long, k2 long, sha string, fp array<long>, lo array<int>, hi array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, ident, sha, found = [], [], [], ([], [], [])
                for text in batch.column(2):
                    text = text.as_py() or b""
                    words = text.split()
                    joined = b" ".join(words)
                    digest = hashlib.sha256(joined)
                    n.append(len(words))
                    ident.append(np.frombuffer(digest.digest()[:16], np.int64))
                    sha.append(digest.hexdigest())
                    for out, part in zip(found, anchors(word_keys(text), window, gram), strict=True):
                        out.append(part)
                arrays = [pa.array(n, pa.int64()), pa.array([int(i[0]) for i in ident], pa.int64()), pa.array([int(i[1]) for i in ident], pa.int64()), pa.array(sha, pa.string())]
                lists = [pa.array(part, pa.list_(kind)) for part, kind in zip(found, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, *lists], ["doc_id", "tk", "n_words", "k1", "k2", "sha", "fp", "lo", "hi"])

    return docs.select("doc_id", "tk", "text").mapInArrow(tidy(run), schema)


_CONTEXT = "fp long, doc_id long, tk long, c1 long, c2 long, n int, words binary, spans array<struct<s:int,e:int>>"


class _Contexts:
    """Collects contexts as rows of _CONTEXT: those of one document with one anchor and equal words are one row."""

    def __init__(self):
        self.rows: dict[tuple, list] = {}
        self.bytes = 0

    def add(self, fp: int, doc_id: int, tk: int, words: bytes, spans: list[tuple[int, int]]) -> None:
        key = (fp, doc_id, tk, words)
        if key not in self.rows:
            self.rows[key] = []
            self.bytes += len(words) + 100
        self.rows[key] += spans

    def batch(self) -> pa.RecordBatch:
        digest = [np.frombuffer(hashlib.sha256(words).digest()[:16], np.int64) for _, _, _, words in self.rows]
        columns = [*zip(*self.rows, strict=True)] or [(), (), (), ()]
        spans = [[{"s": s, "e": e} for s, e in found] for found in self.rows.values()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
        values = (*columns[:3], [int(d[0]) for d in digest], [int(d[1]) for d in digest], [w.count(b" ") + 1 for w in columns[3]], columns[3], spans)
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in _CONTEXT.split(", ")])
        self.__init__()
        return out


def _contexts(texts: DataFrame, window: int) -> DataFrame:
    """Rows of _CONTEXT from rows (doc_id, tk, text, at): the words of each shared run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Contexts()
        for batch in batches:
            for doc_id, tk, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                for r in runs:
                    s, e = r["lo"], r["hi"] + window
                    found.add(r["fp"], doc_id, tk, b" ".join(words[s:e]), [(s, e)])
                    if found.bytes > FLUSH_BYTES:
                        yield found.batch()
        yield found.batch()

    return texts.select("doc_id", "tk", "text", "at").mapInArrow(tidy(run), _CONTEXT)


def _finer(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """The contexts' windows, routed by anchors of ``gram`` words as well. Anchors of the whole window give a row for each window, with all the places where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Contexts()
        for batch in batches:
            for fp, doc_id, tk, text, spans in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                words, starts = text.split(b" "), [r["s"] for r in spans]
                for key, lo, hi in zip(*(x.tolist() for x in anchors(word_keys(text), window, gram)), strict=True):
                    end = hi + window if gram < window else lo + window
                    finer = int(_mix(np.array([fp, key], np.int64).view(np.uint64) * _ORDER[:2]).sum(dtype=np.uint64).view(np.int64))
                    found.add(finer, doc_id, tk, b" ".join(words[lo:end]), [(s + lo, s + hi + window) for s in starts])
                    if found.bytes > FLUSH_BYTES:
                        yield found.batch()
        yield found.batch()

    return contexts.select("fp", "doc_id", "tk", "words", "spans").mapInArrow(tidy(run), _CONTEXT)


def _by_automaton(contexts: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, tk, spans): spans of words that an earlier document's context of the same anchor holds."""
    rows = contexts.select("fp", "doc_id", "tk", "words", "spans").repartition("fp").sortWithinPartitions("fp", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = owner = None
        automaton, names, waiting = SuffixAutomaton(), {}, []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for fp, doc_id, tk, words, places in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if fp != anchor:
                    anchor, owner, automaton, names, waiting = fp, doc_id, SuffixAutomaton(), {}, []
                elif doc_id != owner:
                    for w in waiting:
                        automaton.add(w)
                    owner, waiting = doc_id, []
                coded = [names.setdefault(w, len(names)) for w in words.split(b" ")]
                spans, held = automaton.spans(coded, window)
                if spans:
                    # a window that stands at several places in a row is longer than its words
                    found = [{"s": r["s"] + s, "e": r["e"] - len(coded) + e} for r in places for s, e in spans]
                    for column, value in zip(out, (doc_id, tk, found), strict=True):
                        column.append(value)
                if held <= len(coded) - window:  # spans that cover it can still miss windows where they overlap
                    waiting.append(coded)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "tk", "spans"])

    return rows.mapInArrow(tidy(run), "doc_id long, tk long, spans array<struct<s:int,e:int>>")


def _shared(rows: DataFrame) -> DataFrame:
    """The anchors that several ids have: a table, so that a join can split an anchor that many rows have."""
    return cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("fp"), "shared")


def _spans(contexts: DataFrame, window: int, grams: list[int], words: int) -> DataFrame:
    """Rows (doc_id, tk, spans), some of them empty, of all words that an earlier document's windows cover."""
    found = []
    for gram in [*grams, None]:
        contexts = cut(contexts, "contexts")
        classes = cut(contexts.groupBy("fp", "c1", "c2").agg(F.min("doc_id").alias("first"), F.first("n").alias("size")), "classes")
        again = contexts.drop("words").join(classes.drop("size"), ["fp", "c1", "c2"])
        found.append(again.select("doc_id", "tk", F.when(F.col("doc_id") > F.col("first"), F.col("spans")).otherwise(F.slice("spans", 1, 0)).alias("spans")))
        several = cut(classes.groupBy("fp").agg(F.count("*").alias("classes"), F.sum("size").alias("shard")).where("classes > 1").select("fp", "shard"), "several")
        if several.isEmpty():
            break
        wanted = cut(classes.join(several, "fp").select("fp", "c1", "c2", "first", "shard"), "wanted")
        own = contexts.join(wanted, ["fp", "c1", "c2"]).where("doc_id = first")
        fits = F.col("shard") <= words if gram else F.lit(True)  # beyond the last anchors, classes of one shard differ by a hash's collision only
        found.append(cut(_by_automaton(own.where(fits), window), "matched"))
        if not gram or several.where(~fits).isEmpty():
            break
        finer = cut(_finer(own.where(~fits), window, gram), "finer")
        contexts = finer.join(_shared(finer), "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _removed(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, tk, n_removed, kept_sha, kept) from rows (doc_id, tk, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, spans in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in spans:
                    gone[r["s"]] += 1
                    gone[r["e"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                for column, value in zip(out, (int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "tk", "n_removed", "kept_sha", "kept"])

    return rows.mapInArrow(tidy(run), "doc_id long, tk long, n_removed long, kept_sha string, kept binary")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, once each; the ids are broadcast up to BROADCAST_IDS of them."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tk, text); tk is a hash of the text, as ids may repeat."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, words: int = SHARD_WORDS) -> DataFrame:
    """Rows (doc_id, tk, n_words, n_removed, kept_sha, kept): ``kept`` is the text of the words that stay, or null where none was removed. A shard holds at most about ``words`` words."""
    ready(docs.sparkSession)
    with scratch():
        return cut(_substring_dedup(docs, window, gram, words), "substring", result=True)


def _substring_dedup(docs: DataFrame, window: int, gram: int, words: int) -> DataFrame:
    docs = _keyed(docs)
    profile = cut(_profile(docs, window, gram), "profile")
    first = profile.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    profile = cut(profile.join(first, ["k1", "k2"]).drop("k1", "k2").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "profile")
    own = profile.where(~F.col("copy") & F.col("doc_id").isNotNull() & (F.size("fp") > 0)).dropDuplicates(["doc_id", "tk"])
    runs = own.select("doc_id", "tk", F.explode(F.arrays_zip("fp", "lo", "hi")).alias("r")).select("doc_id", "tk", "r.fp", "r.lo", "r.hi")
    wanted = cut(runs.join(_shared(runs), "fp").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("fp", "lo", "hi")).alias("at")), "wanted")
    contexts = _contexts(_only(docs, wanted.select("doc_id", "tk")).join(wanted, ["doc_id", "tk"]), window)
    spans = _spans(contexts, window, [n for n in (2 * gram,) if n < window] + [window], words)
    spans = cut(spans.groupBy("doc_id", "tk").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0), "spans")
    removed = _removed(_only(docs, spans.select("doc_id", "tk")).join(spans, ["doc_id", "tk"]).select("doc_id", "tk", "text", "spans"))
    out = profile.select("doc_id", "tk", "n_words", "sha", (F.col("copy") & (F.col("n_words") >= window)).alias("gone")).join(removed, ["doc_id", "tk"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "tk",
        "n_words",
        F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
        F.when(F.col("gone"), F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"),
    )


def removal_digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.col("kept_sha").alias("kept_sha256"))


def drop_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, less the covered words. Texts that lose none stay as they are; those that do are their words joined by blanks, and n_chars, where there is one, follows."""
    changed = substring_dedup(docs, window).where("n_removed > 0").dropDuplicates(["doc_id", "tk"])
    changed = changed.select(F.col("doc_id").alias("changed_id"), F.col("tk").alias("changed_tk"), F.col("kept").alias("new"))
    ids = changed.select("changed_id", "changed_tk")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # in one column, so that no name of theirs clashes
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.xxhash64(F.col("text").cast("binary")).alias("row_tk"))
    same = (F.col("row.doc_id").cast("long") == F.col("changed_id")) & (F.col("row_tk") == F.col("changed_tk"))
    new = rows.join(ids, same, "left_semi").select(F.col("row").dropFields("text").alias("row"), "row_tk").join(changed, same)
    text = F.coalesce("new", F.lit(""))
    columns = [(text if c == "text" else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.join(ids, same, "left_anti").select("row.*").union(new.select(*columns))
