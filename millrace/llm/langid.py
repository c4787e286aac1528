"""Language identification by word-first backoff.

From the documents that have a language and aren't held out, words and the n-grams of 4 to 1 letters inside
them are counted by language, over all of them. A word that is known (seen more than once in some language)
adds its log frequency in each language; any other word falls back to its n-grams of 4 letters that were
counted, then 3, 2 and 1, the first length of which it has any. The best sum names the language; the score is
its share among all languages' likelihoods, tempered by the number of words so that a long text isn't always 1.

The model is sparse: an entry is a key, a language and the log frequency there, kept for every language that
has the key. Every n-gram counted and every known word has its entries, whatever the input. Up to
MODEL_ENTRIES are broadcast. Beyond that only those of the most frequent keys are, as many as fit; words that
aren't among them, once each, get their log frequencies by a join of their keys with the other entries, and
documents theirs by a join with those words. Both ways give the same predictions, and the same scores up to
the order in which doubles are added.

Defined results: a null text, or one without letters (Unicode category L), is ``und`` with score 0; texts of
any length count whole, runs of more than lexical.LONGEST letters as several words; without training documents
every text is ``und``; equal sums go to the first language in order; repeated rows and null ids are kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import columns, cut, is_held_out, ready, scratch, tidy
from millrace.llm.lexical import Marked, longs, lookup, mixed, words_of

SIZES = (4, 3, 2, 1)
SHARE = 0.0  # of a language's counts that a key must reach to be known: none
MODEL_ENTRIES = 2_000_000
FLUSH_WORDS = 200_000
MEMO_FLOATS = 600_000
UNKNOWN = "und"


def _grams(m: Marked) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, keys, word numbers) of the n-grams that lie wholly inside the marked word."""
    sums = m.sums(max(SIZES))
    for n in SIZES:
        inside = (m.place >= n - 1) & ((n > 1) | ((m.place > 0) & (np.append(m.place[1:], 0) > 0)))
        yield n, mixed(sums[n - 1][inside] + np.uint64(n)), m.word[inside]


def _kinds(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, word numbers): kind 0 is whole words, n is n-grams."""
    m = Marked(words)
    yield 0, m.keys(), np.arange(len(words))
    yield from _grams(m)


def count_keys(docs: DataFrame) -> DataFrame:
    """Rows (lang, kind, key, n) over all training texts, summed in the workers before the shuffle."""

    def tables(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in seen.items():
            words, weight = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
            if not words:
                continue
            for kind, keys, word in _kinds(words):
                key, back = np.unique(keys, return_inverse=True)
                n = np.bincount(back, weight[word], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), longs(key), pa.array(n)], ["lang", "kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(words_of(text.as_py()))
                if sum(map(len, seen.values())) > FLUSH_WORDS:
                    yield from tables(seen)
                    seen.clear()
        yield from tables(seen)

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    found = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(tidy(run), "lang string, kind int, key long, n long")
    return found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Keys in order; from starts[i] to starts[i + 1] the languages that have key i and by how much its log frequency there exceeds an absent one's."""

    keys: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def add(self, keys: np.ndarray, word: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds to ``total`` [word, language] what the listed keys have; which of the keys are listed."""
        at = lookup(self.keys, keys)
        listed = at >= 0
        word, at = word[listed], at[listed]
        size = self.starts[at + 1] - self.starts[at]
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[at], size)
        cell = np.repeat(word, size) * total.shape[1] + self.language[entry]
        total += np.bincount(cell, self.more[entry], total.size).reshape(total.shape)
        return listed


@dataclass
class Model:
    """Tables of keys by kind, and an absent key's log frequency by kind and language. With ``rest``, a table (kind, key, entries) of all other keys, the tables hold the frequent ones only."""

    languages: list[str]
    tables: dict[int, Table]
    absent: np.ndarray
    rest: DataFrame | None = None

    def listed(self, kind: int, keys: np.ndarray, word: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self.tables[kind].add(keys, word, total) if kind in self.tables else np.zeros(len(keys), bool)

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies [word, language] of the listed words, and which words are listed."""
        out = np.zeros((len(words), len(self.languages)))
        known = self.listed(0, Marked(words).keys(), np.arange(len(words)), out)
        out[known] += self.absent[0]
        return out, known

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log frequencies [word, language]: of the word, or else the mean over its n-grams of the longest length that has any."""
        out, known = self.whole(words)
        left = np.flatnonzero(~known)
        if len(left):
            kind, more = self.by_grams([words[i] for i in left], [])
            out[left] = np.where(kind[:, None] > 0, more + self.absent[kind], 0.0)
        return out

    def by_grams(self, words: list[str], found: list[tuple[int, int, list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
        """The longest length of which a word has counted n-grams (0: none), and by how much their mean exceeds an absent one's. ``found``: of n-grams that aren't listed the word, length, languages and entries."""
        kind, more = np.zeros(len(words), np.int64), np.zeros((len(words), len(self.languages)))
        by = defaultdict(list)
        for word, n, language, values in found:
            by[n].append((word, language, values))
        for n, keys, word in _grams(Marked(words)):
            use = kind[word] == 0
            total = np.zeros_like(more)
            keys, word = keys[use], word[use]
            hits = np.bincount(word[self.listed(n, keys, word, total)], minlength=len(words))
            for w, language, values in by[n]:
                hits[w] += 1
                total[w, language] += values
            got = (hits > 0) & (kind == 0)
            more[got] = total[got] / hits[got, None]
            kind[got] = n
            if kind.all():
                break
        return kind, more


def train(docs: DataFrame) -> Model:
    ready(docs.sparkSession)
    with scratch():
        return _train(docs)


def _train(docs: DataFrame) -> Model:
    counts = cut(count_keys(docs), "keys")
    sums = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", "kind").agg(F.sum("n")).collect()}
    languages = sorted({lang for lang, _ in sums})
    absent = np.log(0.1 / (np.array([[sums.get((lang, kind), 0) for lang in languages] for kind in range(max(SIZES) + 1)], float) + 1))
    if not languages:
        return Model([], {}, absent)
    code = {lang: i for i, lang in enumerate(languages)}
    totals = counts.sparkSession.createDataFrame([(lang, kind, code[lang], n) for (lang, kind), n in sums.items()], "lang string, kind int, language int, total long")
    more = (F.log(F.col("n") + F.lit(0.1)) - F.log(F.lit(0.1))).cast("float")
    entry = F.collect_list(F.struct("language", more.alias("more")))
    keys = counts.join(F.broadcast(totals), ["lang", "kind"]).groupBy("kind", "key").agg(entry.alias("entries"), F.max(F.col("n") / F.col("total")).alias("share"), F.max("n").alias("most"))
    level = F.floor(F.log2("share")).cast("int")
    keys = cut(keys.where("kind > 0 OR most > 1").select("kind", "key", "entries", level.alias("level")), "entries")
    sizes = keys.groupBy("level").agg(F.sum(F.size("entries"))).collect()  # a row for each power of two
    fits, least = 0, 1
    for at, size in sorted(map(tuple, sizes), reverse=True):
        fits += size
        if fits > MODEL_ENTRIES:
            break
        least = at
    frequent = F.col("level") >= least
    rest = cut(keys.where(~frequent).drop("level"), "rest", result=True) if fits > MODEL_ENTRIES else None
    listed = keys.where(frequent).select("kind", "key", F.explode("entries").alias("e")).select("kind", "key", "e.language", "e.more")
    kinds, found, codes, values = columns(listed)  # at most MODEL_ENTRIES rows
    tables: dict[int, Table] = {}
    for kind in np.unique(kinds).tolist():
        part = np.flatnonzero(kinds == kind)
        part = part[np.lexsort((codes[part], found[part].view(np.uint64)))]
        key = found[part].view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tables[kind] = Table(key[new], np.append(new, len(key)), codes[part].astype(np.int32), values[part].astype(np.float32))
    return Model(languages, tables, absent, rest)


def told(languages: list[str], sums: np.ndarray, n: float) -> tuple[str, float]:
    """(language, score) of a text of n words, from their sums by language."""
    if not n or not languages:
        return UNKNOWN, 0.0
    best = int(sums.argmax())
    share = np.exp((sums - sums[best]) / max(1.0, np.sqrt(n)))
    return languages[best], float(1 / share.sum())


def _remember(memo: dict, split: list[Counter], width: int, find) -> None:
    """Puts every word of ``split`` into ``memo``; ``find`` gives values of width floats. The memo holds about MEMO_FLOATS."""
    new = list({w for words in split for w in words} - memo.keys())
    if (len(memo) + len(new)) * width > MEMO_FLOATS:
        memo.clear()
        new = list({w for words in split for w in words})
    memo.update(zip(new, find(new), strict=True))


def detect(model: Model, texts: list[str | None], memo: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    split = [Counter(words_of(t)) for t in texts]
    _remember(memo, split, len(model.languages), model.evidence)
    names, scores = [], []
    for words in split:
        n = np.fromiter(words.values(), float, len(words))
        name, score = told(model.languages, n @ np.array([memo[w] for w in words]) if words else n, n.sum())
        names.append(name)
        scores.append(score)
    return names, scores


def _identify_texts(texts: DataFrame, model: Model) -> DataFrame:
    """A row (k, lang_pred, score) for each distinct key from rows (k, text), where the broadcast doesn't hold every key."""
    sent = texts.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    width = len(model.languages)
    opened = pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64())]))
    slots = pa.list_(pa.struct([("slot", pa.int32()), ("more", pa.float64())]))

    def listed(words: list[str]) -> list[np.ndarray | None]:
        out, known = sent.value.whole(words)
        return [v if k else None for v, k in zip(out, known.tolist(), strict=True)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                split = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
                _remember(memo, split, width, listed)
                sums, open_ = [], []
                for words in split:
                    known = [w for w in words if memo[w] is not None]
                    n = np.array([words[w] for w in known], float)
                    sums.append(n @ np.array([memo[w] for w in known]) if known else np.zeros(width))
                    open_.append([{"w": w, "c": c} for w, c in words.items() if memo[w] is None])
                n = pa.array([words.total() for words in split], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(sums, pa.list_(pa.float64())), pa.array(open_, opened)], ["k", "n", "sums", "open"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word itself, which isn't listed, and its n-grams that aren't."""
        for batch in batches:
            words = batch.column(0).to_pylist()
            for kind, keys, word in _kinds(words):
                table = sent.value.tables.get(kind)
                other = lookup(table.keys, keys) < 0 if table else np.ones(len(keys), bool)
                own = batch.column(0).take(pa.array(word[other]))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(other.sum(), kind, np.int32)), longs(keys[other])], ["w", "kind", "key"])

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a word adds to each language beyond absence, and, past the languages' slots, its kind."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(i, f["kind"], [e["language"] for e in f["entries"]], [e["more"] for e in f["entries"]]) for i, rows in enumerate(lists) for f in rows]
                kind, more = sent.value.by_grams(words, [f for f in found if f[1]])
                known = np.zeros(len(words), bool)
                for i, n, language, values in found:
                    if not n:
                        more[i] = 0.0
                        more[i, language] = values
                        known[i] = True
                kind[known] = 0
                adds = []
                for i in range(len(words)):
                    some = np.flatnonzero(more[i])
                    adds.append([{"slot": s, "more": m} for s, m in zip(some.tolist(), more[i, some].tolist(), strict=True)])
                    if known[i] or kind[i]:
                        adds[-1].append({"slot": width + int(kind[i]), "more": 1.0})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(adds, slots)], ["w", "adds"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, absent = sent.value.languages, sent.value.absent
        for batch in batches:
            names, scores = [], []
            for n, sums, adds in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                more = np.zeros(width + len(absent))
                for a in adds or []:
                    more[a["slot"]] = a["more"]
                name, score = told(languages, np.array(sums) + more[:width] + more[width:] @ absent, n)
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    with scratch():
        # as tables, so that the joins can split an n-gram or a word that many rows have
        found = cut(texts.mapInArrow(tidy(parts), "k binary, n long, sums array<double>, open array<struct<w:string,c:long>>").dropDuplicates(["k"]), "parts")
        pairs = found.select("k", F.explode("open").alias("o")).select("k", "o.w", "o.c")
        need = cut(pairs.select("w").distinct().mapInArrow(tidy(needed), "w string, kind int, key long"), "need")
        have = F.when(F.col("entries").isNotNull(), F.struct("kind", "entries"))
        words = need.join(model.rest, ["kind", "key"], "left").groupBy("w").agg(F.collect_list(have).alias("have"))  # a word's n-grams
        words = cut(words.mapInArrow(tidy(evidence), "w string, adds array<struct<slot:int,more:double>>"), "words")
        adds = pairs.join(words, "w").select("k", "c", "adds").repartition("k").select("k", "c", F.explode("adds").alias("a"))
        adds = adds.groupBy("k", F.col("a.slot").alias("slot")).agg(F.sum(F.col("c") * F.col("a.more")).alias("more")).groupBy("k").agg(F.collect_list(F.struct("slot", "more")).alias("adds"))
        done = found.select("k", "n", "sums").join(adds, "k", "left").select("k", "n", "sums", "adds")
        return cut(done.mapInArrow(tidy(finish), "k binary, lang_pred string, score double"), "languages", result=True)


def identify(docs: DataFrame, model: Model | None = None, extra: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, lang_pred, score) and the ``extra`` columns, of every whole text: by the broadcast model, or with ``rest`` by joins."""
    model = model or train(docs)
    if model.rest is not None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        key = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
        known = _identify_texts(docs.select(key.alias("k"), text.alias("text")), model)
        rows = docs.select("doc_id", *(extra or []), key.alias("text_key"))
        return rows.join(known, rows["text_key"] == known["k"]).select("doc_id", *(extra or []), "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *(extra or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                names, scores = detect(sent.value, batch.column(0).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    out = identify(docs)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of at least ``least``."""
    rows = docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    return identify(rows, train(docs), ["row"]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
