"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

From the labelled documents that aren't held out, n-grams of up to HISTORY + 1 letters are counted by class,
over all of them. An n-gram's probability in a class is interpolated Kneser-Ney: its discounted count over its
history's, and the mass set free goes to the continuation counts of shorter histories. Those backoff counts
are shared by both classes, so a rare expression has the same estimate in either and says nothing. A word's
log-odds are its toxic less its ordinary log-likelihood. A toxic text isn't toxic in every word, so its
model draws a share MIXED of the words from the toxic class and the others from the ordinary one. The figure
of a document is its log-likelihood under that model less the ordinary one, summed over every word and
normalised by length (the number of words, and STEADY more so that a text of few words isn't judged by them
alone).

The score is a logistic curve over that figure, fitted on labelled documents that the counts leave out:
about one in five, and no more than about CALIBRATION_ROWS of them whatever the input (the bound of this
sample). Counts cover all other labelled documents, and every n-gram counted has its ratio. Up to WHOLE
n-grams are broadcast. Beyond that only those that make up at least SHARE of a class's letters are, at most
2 / SHARE; words that hold any other n-gram, once each, get the rest of their log-odds by joins with the whole
table, and documents theirs by a join with those words. Both ways give the same scores.

Defined results: a null or empty text, or one without letters, has the figure 0 and its score; texts of any
length count whole, but runs of more than lexical.LONGEST letters as several words of that length;
without a toxic (an ordinary) training document every score is 0 (1); labels that are null or repeat count
once, as their largest; repeated rows and null ids are kept; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import columns, cut, is_held_out, ready, scratch, tidy
from millrace.llm.lexical import Marked, id_share, longs, lookup, mixed, slices, words_of

HISTORY = 5
SHARED = (3, 1)
DISCOUNT = 0.75
PRIOR = 10.0
SHARE = 1e-6
WHOLE = 2_000_000
MIXED = 0.003
STEADY = 20
CALIBRATION_ROWS = 20_000
FLUSH_WORDS = 200_000
FLUSH_GRAMS = 300_000
SENT_ROWS = 50_000
MEMO_WORDS = 200_000
BROADCAST_LABELS = 1_000_000


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic) with a label. Up to BROADCAST_LABELS labels are broadcast; more are joined by sorting."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id")


def count_grams(rows: DataFrame) -> DataFrame:
    """Rows (g, h, a, ah, b, bh, n0, n1): keys of the n-gram, its history, and both shortened by the shared orders; counts in ordinary and toxic text."""

    names = ["g", "h", "a", "ah", "b", "bh", "n0", "n1"]

    def summed(rows: list[np.ndarray]) -> np.ndarray:
        """A column for each key of the first row; the last two rows are added up, the others depend on the key."""
        key, at, back = np.unique(rows[0], return_index=True, return_inverse=True)
        return np.stack([key, *(r[at] for r in rows[1:-2]), *(np.bincount(back, r, len(key)).astype(np.uint64) for r in rows[-2:])])

    def grams(words: list[str], seen: tuple[Counter, Counter]) -> np.ndarray:
        m = Marked(words)
        inner = m.place > 0
        sums, own = m.sums(HISTORY + 1), m.first()[inner]
        g, a, b = (sums[k][inner] for k in (HISTORY, *SHARED))
        counts = (np.array([s[w] for w in words], np.uint64)[m.word[inner]] for s in seen)
        return summed([g, g - own, a, a - own, b, b - own, *counts])

    def sent(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.shape[1], SENT_ROWS):
            yield pa.RecordBatch.from_arrays([longs(c) for c in table[:, at : at + SENT_ROWS]], names)

    def tables(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        """The n-grams of all words seen, each once, unless they are more than FLUSH_GRAMS."""
        table = np.zeros((len(names), 0), np.uint64)
        for _, words in slices([*seen[0], *(w for w in seen[1] if w not in seen[0])]):
            table = summed([np.concatenate(r) for r in zip(table, grams(words, seen), strict=True)])
            if table.shape[1] > FLUSH_GRAMS:
                yield from sent(table)
                table = table[:, :0]
        yield from sent(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update(words_of(text.as_py()))
                if len(seen[0]) + len(seen[1]) > FLUSH_WORDS:
                    yield from tables(seen)
                    seen = (Counter(), Counter())
        yield from tables(seen)

    found = rows.select("text", "toxic").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))
    return found.groupBy("g").agg(*(F.first(c).alias(c) for c in ("h", "a", "ah", "b", "bh")), *(F.sum(c).alias(c) for c in ("n0", "n1")))


@dataclass
class Model:
    """Log-likelihood ratios of n-grams and, for n-grams that aren't listed, of histories; a logistic curve over a document's figure. With ``rest``, tables of all n-grams (g, llr) and histories (h, llr), the arrays hold the frequent n-grams only."""

    grams: np.ndarray
    gram_llr: np.ndarray
    histories: np.ndarray
    history_llr: np.ndarray
    slope: float = 1.0
    middle: float = 3.0
    constant: float | None = None
    rest: tuple[DataFrame, DataFrame] | None = None

    def listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's log-odds from listed n-grams; of the other n-grams, keys, histories' keys and word numbers."""
        parts = [(np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for at, part in slices(words):
            odds, g, histories, word = self._listed(part)
            parts.append((odds, g, histories, word + at))
        odds, g, histories, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        return odds, g, histories, word

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = Marked(words)
        inner = np.flatnonzero(m.place > 0)
        g = m.sums(HISTORY + 1)[-1][inner]
        at = lookup(self.grams, mixed(g))
        llr = np.where(at >= 0, self.gram_llr[at] if len(self.gram_llr) else 0.0, 0.0)
        word, other = m.word[inner], at < 0
        return np.bincount(word, llr, len(words)), g[other], (g - m.first()[inner])[other], word[other]

    def evidence(self, words: list[str]) -> np.ndarray:
        sums, _, histories, word = self.listed(words)
        at = lookup(self.histories, mixed(histories))
        llr = np.where(at >= 0, self.history_llr[at] if len(self.history_llr) else 0.0, 0.0)
        return sums + np.bincount(word, llr, len(words))

    def score(self, figure: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(figure), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (figure - self.middle), -60, 60)))


def mixture(odds: np.ndarray) -> np.ndarray:
    """What words with these log-odds add to a text's log-likelihood when a share MIXED of its words is toxic."""
    return np.log1p(MIXED * np.expm1(np.minimum(odds, 60.0)))


def figures(model: Model, texts: list[str | None], memo: dict[str, float]) -> np.ndarray:
    split = [words_of(t) for t in texts]
    new = list({w for words in split for w in words} - memo.keys())
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = list({w for words in split for w in words})
    memo.update(zip(new, mixture(model.evidence(new)).tolist(), strict=True))
    out = np.zeros(len(texts))
    for i, words in enumerate(split):
        if words:
            out[i] = math.fsum(map(memo.__getitem__, words)) / (len(words) + STEADY)
    return out


def train_counts(rows: DataFrame) -> Model:
    """The model without its curve."""
    with scratch():
        return _train_counts(rows)


def _train_counts(rows: DataFrame) -> Model:
    grams = cut(count_grams(rows), "grams")
    total = grams.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if not total[0] or not total[1]:
        empty = np.zeros(0)
        return Model(np.zeros(0, np.uint64), empty, np.zeros(0, np.uint64), empty, constant=1.0 if total[1] else 0.0)
    d = F.lit(DISCOUNT)

    def freed(n: str):
        return F.sum(F.greatest(F.col(n) - d, F.lit(0.0)))

    history = grams.groupBy("h").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"), freed("n0").alias("k0"), freed("n1").alias("k1"))
    for c in ("0", "1"):
        history = history.withColumn(f"l{c}", F.when(F.col(f"h{c}") > 0, 1 - F.col(f"k{c}") / (F.col(f"h{c}") + PRIOR)).otherwise(1.0))
    mid = grams.groupBy("a").agg(F.first("ah").alias("ah"), F.first("b").alias("b"), F.first("bh").alias("bh"), F.count("*").alias("na"))
    mid_h = mid.groupBy("ah").agg(F.sum("na").alias("ma"), F.count("*").alias("ta"))
    low = mid.groupBy("b").agg(F.first("bh").alias("bh"), F.count("*").alias("nb"))
    low_h = low.groupBy("bh").agg(F.sum("nb").alias("mb"), F.count("*").alias("tb"))
    letters = F.lit(float(low_h.agg(F.max("tb")).first()[0]))
    low = low.join(low_h, "bh").select("b", ((F.greatest(F.col("nb") - d, F.lit(0.0)) + d * F.col("tb") / letters) / F.col("mb")).alias("pb"))
    mid = mid.join(mid_h, "ah").join(low, "b").select("a", ((F.greatest(F.col("na") - d, F.lit(0.0)) + d * F.col("ta") * F.col("pb")) / F.col("ma")).alias("pa"))
    rows = grams.join(history, "h").join(mid, "a")

    def p(c: str):
        own = F.when(F.col(f"h{c}") > 0, F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / (F.col(f"h{c}") + PRIOR)).otherwise(0.0)
        return own + F.col(f"l{c}") * F.col("pa")

    frequent = (F.col("n0") >= SHARE * total[0]) | (F.col("n1") >= SHARE * total[1])
    ratios = rows.select("g", F.log(p("1") / p("0")).cast("float").alias("llr"), frequent.alias("frequent"))
    others = history.select("h", F.log(F.col("l1") / F.col("l0")).cast("float").alias("llr"))

    def ordered(keys, values):
        keys = mixed(np.asarray(keys, np.int64).view(np.uint64))
        order = np.argsort(keys)
        return keys[order], np.asarray(values, np.float32)[order]

    if grams.count() > WHOLE:
        ratios, others = cut(ratios, "ratios", result=True), cut(others, "others", result=True)
        table = columns(ratios.where("frequent").select("g", "llr"))  # at most 2 / SHARE rows
        return Model(*ordered(*table), *ordered([], []), rest=(ratios.select("g", "llr"), others))
    return Model(*ordered(*columns(ratios.select("g", "llr"))), *ordered(*columns(others)))  # at most WHOLE rows, and no more histories


def fit_curve(figure: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, middle): the middle of the widest stretch of thresholds with the fewest errors, and the logistic slope there."""
    order = np.argsort(figure, kind="stable")
    x, y = figure[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    width = edges[1:] - edges[:-1]
    best = np.flatnonzero((wrong == wrong[width > 0].min()) & (width > 0))
    i = best[width[best].argmax()]
    middle = (edges[i] + edges[i + 1]) / 2
    scale = float(x.std()) or 1.0
    x, slope = (x - middle) / scale, 1.0
    for _ in range(50):
        z = np.clip(slope * x, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = ((y - p) * x).sum() - 0.01 * slope
        curve = (p * (1 - p) * x**2).sum() + 0.01
        slope = min(20.0, max(0.05, slope + grad / curve))
    return slope / scale, float(middle)


def _text_figures(texts: DataFrame, model: Model) -> DataFrame:
    """A row (k, figure) for each distinct key from rows (k, text), where the broadcast doesn't hold every n-gram."""
    sent = texts.sparkSession.sparkContext.broadcast(replace(model, rest=None))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                split = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
                words = list({w for seen in split for w in seen})
                odds, _, _, other = sent.value.listed(words)
                adds = mixture(odds)
                adds[other] = np.nan
                known = dict(zip(words, adds.tolist(), strict=True))
                n = [seen.total() for seen in split]
                sums = [math.fsum(c * known[w] for w, c in seen.items() if known[w] == known[w]) for seen in split]
                open_ = [[{"w": w, "c": c} for w, c in seen.items() if known[w] != known[w]] for seen in split]
                kinds = (pa.int64(), pa.float64(), pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n, sums, open_), kinds, strict=True))], ["k", "n", "known", "open"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            odds, g, h, word = sent.value.listed(words)
            first = np.diff(word, prepend=-1) > 0  # a word's listed part goes with the first of its other n-grams
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in word], pa.string()), pa.array(np.where(first, odds[word], 0.0)), longs(g), longs(h)], ["w", "own", "g", "h"])

    with scratch():
        # as tables, so that the joins can split an n-gram or a word that many rows have
        found = cut(texts.mapInArrow(tidy(parts), "k string, n long, known double, open array<struct<w:string,c:long>>").dropDuplicates(["k"]), "parts")
        pairs = found.select("k", F.explode("open").alias("o")).select("k", "o.w", "o.c")
        need = cut(pairs.select("w").distinct().mapInArrow(tidy(grams), "w string, own double, g long, h long"), "need")
        ratios, others = model.rest
        need = need.join(ratios.withColumnRenamed("llr", "r"), "g", "left").join(others.withColumnRenamed("llr", "o"), "h", "left")
        odds = need.groupBy("w").agg(F.sum(F.col("own") + F.coalesce("r", "o", F.lit(0.0)).cast("double")).alias("e"))
        odds = cut(odds.select("w", F.log1p(MIXED * F.expm1(F.least("e", F.lit(60.0)))).alias("add")), "odds")
        more = pairs.join(odds, "w").groupBy("k").agg(F.sum(F.col("c") * F.col("add")).alias("more"))
        figure = (F.col("known") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + STEADY)
        return cut(found.join(more, "k", "left").select("k", figure.alias("figure")), "figures", result=True)


def score_rows(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """Rows of doc_id, the ``extra`` columns, figure and score: by the broadcast model, or with ``rest`` by joins."""
    if model.rest is not None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        known = _text_figures(docs.select(F.sha2(text, 256).alias("k"), text.alias("text")), model)
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), model.slope * (F.col("figure") - model.middle)))))
        rows = docs.select("doc_id", *(extra or []), F.sha2(text, 256).alias("text_key"))
        return rows.join(known, rows["text_key"] == known["k"]).select("doc_id", *(extra or []), "figure", score.alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *(extra or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                f = figures(sent.value, batch.column(0).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(f), pa.array(sent.value.score(f))], [*batch.schema.names[1:], "figure", "score"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("figure", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    ready(docs.sparkSession)
    rows = _labelled(docs, labels).where(~is_held_out(F.col("doc_id")))
    parts = max(5, -(-labels.count() // CALIBRATION_ROWS))
    fold = id_share(F.col("doc_id"), "curve", parts)
    model = train_counts(rows.where(fold != 0))
    if model.constant is None:
        figure, toxic = columns(score_rows(rows.where(fold == 0), model, ["toxic"]).select("figure", "toxic"))  # about CALIBRATION_ROWS at most
        toxic = (toxic > 0).astype(int)
        if 0 < toxic.sum() < len(toxic):
            model.slope, model.middle = fit_curve(figure, toxic)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every whole text."""
    scored = score_rows(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    rows = docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    return score_rows(rows, train(docs, labels), ["row"]).where("score < 0.5").select("row.*")
