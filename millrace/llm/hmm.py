"""Language model scores by a hidden Markov model over words.

Words of the training documents are counted, all of them. Those that make up at least SHARE of all tokens are units
of the model (so no more than 1 / SHARE); each of the others belongs to one of CLASSES classes by its last letters,
which is a unit too, and within its class its probability is its own count plus one, over the class's, with one place
for all words never seen. A text is its words and one end. Baum-Welch fits STATES latent states to the units of
whole training documents: in each of ROUNDS passes every partition adds up expected counts by scaled forward and
backward recursions over windows of at most WINDOW tokens, the counts are summed across partitions, and the sums are
the next model. The first counts take a text's commonest unit, modulo STATES, as the state of
its tokens, and a share MOVING of the moves is dealt to all states alike. The score is the exact likelihood of the
whole text: the scaled forward recursion over all its units, from the first to the end, with the words' shares of their
classes. Documents are coded once, as a table of units, which the passes and the scores read; how often the other
words were seen is joined to them, so the vocabulary has no bound.

Defined results: a null or empty text, or one without words, is its end alone; texts of any length count whole;
without training documents every known count is 0 and every state alike; repeated rows and null ids are kept (a null
id trains); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ready, scratch, tidy

STATES = 8
ROUNDS = 4
WINDOW = 1024
SHARE = 4e-6
CLASSES = 1024
ENDING = 3
PRIOR = 10.0
MOVING = 0.1
FLUSH_WORDS = 300_000
TOKENS = 1_000_000
VALUES = [f"v{s}" for s in range(STATES)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    """The words, A-Z in lower case; bytes know the letters and blanks of ASCII only."""
    return text.lower().split() if text else []


def class_of(word: bytes) -> int:
    return crc32(word[-ENDING:]) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (w, class, c) of every word of a column of texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            cols = [pa.array(words, pa.binary()).cast(pa.string()), pa.array([class_of(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, ["w", "class", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH_WORDS:
                    yield out()
        if seen:
            yield out()

    return texts.mapInArrow(tidy(run), "w string, class int, c long").groupBy("w").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The units: frequent words by falling counts, CLASSES classes, the end. ``mass`` counts each unit's tokens, ``kinds`` its words, ``tokens`` and ``distinct`` those of the training documents."""

    words: list[bytes]
    mass: np.ndarray
    kinds: np.ndarray
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return len(self.mass) - 1


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    n, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens = n + documents
    frequent = counts.where(F.col("c") >= SHARE * tokens).select("w", "c").toArrow()  # at most 1 / SHARE rows
    listed = sorted(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    mass, number = np.zeros(len(listed) + CLASSES + 1), np.zeros(len(listed) + CLASSES + 1)
    mass[: len(listed)], number[: len(listed)] = [c for _, c in listed], 1
    for r in counts.where(F.col("c") < SHARE * tokens).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # at most CLASSES rows
        mass[len(listed) + r["class"]], number[len(listed) + r["class"]] = r["c"], r["n"]
    mass[-1], number[-1] = documents, 1 if documents else 0
    return Vocabulary([w.encode() for w, _ in listed], mass, number, tokens, kinds + (1 if documents else 0))


def code(rows: DataFrame, known: Vocabulary) -> DataFrame:
    """Rows (rid, doc_id, held_out, units, other) of rows (rid, doc_id, held_out, text): the units of the words, and how often each word that is no unit occurs."""
    sent = rows.sparkSession.sparkContext.broadcast(known.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = {w: i for i, w in enumerate(sent.value)}
        base = len(unit)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                units, other = [], []
                for text in batch.column(3):
                    words = words_of(text.as_py())
                    found = list(map(unit.get, words))
                    rest: Counter = Counter(w for w, u in zip(words, found, strict=True) if u is None)
                    code_ = {w: base + class_of(w) for w in rest}
                    if rest:
                        found = [code_[w] if u is None else u for w, u in zip(words, found, strict=True)]
                    units.append(np.array(found, np.int32))
                    other.append(rest)
                sizes = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int32)
                coded = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*units, np.zeros(0, np.int32)])))
                ends = np.concatenate([[0], np.cumsum([len(r) for r in other])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array([w for r in other for w in r], pa.binary()).cast(pa.string()), pa.array([n for r in other for n in r.values()], pa.int32())], ["w", "m"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], coded, pa.ListArray.from_arrays(pa.array(ends), pairs)], ["rid", "doc_id", "held_out", "units", "other"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("rid", "doc_id", "held_out", "text").mapInArrow(tidy(run), f"rid long, doc_id {kind}, held_out boolean, units array<int>, other array<struct<w:string,m:int>>")


@dataclass
class Model:
    """``start``: of a text's first state; ``state``: how often each state is taken; ``moves``: from state to state; ``emits``: of a unit (row) in a state."""

    start: np.ndarray
    state: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


class Steps:
    """Sequences of units side by side, the longest first: at step t the first ``active[t]`` of them have a token, and these lie together from ``at[t]`` on."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[self.order], np.cumsum(sizes)[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(longest), "left")
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.at[step] + row
        self.row, self.units = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        self.row[place] = row
        self.units[place] = units[np.repeat(ends - sizes, sizes) + step]

    def forward(self, model: Model, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, scaled forward values, scales) of every token; ``first``: the distribution of each sequence's first state."""
        emits = model.emits[self.units]
        alpha, scale = np.empty_like(emits), np.empty(len(emits))
        now = first[self.order]
        for t, n in enumerate(self.active.tolist()):
            a, b = int(self.at[t]), int(self.at[t]) + n
            now = (now[:n] if not t else now[:n] @ model.moves) * emits[a:b]
            scale[a:b] = now.sum(1)
            now = now / scale[a:b, None]
            alpha[a:b] = now
        return emits, alpha, scale

    def log10(self, model: Model, first: np.ndarray) -> np.ndarray:
        """The log-likelihood of each sequence."""
        scale = self.forward(model, first)[2]
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.row, np.log10(scale), len(self.order))
        return out

    def expected(self, model: Model, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the probability of each state at every token, expected moves)."""
        emits, alpha, scale = self.forward(model, first)
        moved = np.zeros_like(model.moves)
        after = None
        for t in range(len(self.active) - 1, -1, -1):
            a, n = int(self.at[t]), int(self.active[t])
            beta = np.ones((n, len(moved)))
            if after is not None:
                m = len(after)
                moved += alpha[a : a + m].T @ after
                beta[:m] = after @ model.moves.T
            after = beta * emits[a : a + n] / scale[a : a + n, None]
            alpha[a : a + n] *= beta
        return alpha, moved * model.moves


def _sequences(batch: pa.RecordBatch, column: int, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, units, sizes) of slices of about TOKENS tokens; each text is followed by ``end``."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    group = (offsets[:-1] - offsets[0]) // TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lists)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            sizes = np.diff(offsets[a : b + 1])
            yield a, b - a, np.insert(values[offsets[a] : offsets[b]], np.cumsum(sizes), end), sizes + 1


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of windows, whether each is a text's first)."""
    parts = -(-sizes // WINDOW)
    opening = np.zeros(int(parts.sum()), bool)
    opening[np.cumsum(parts) - parts] = True
    out = np.full(len(opening), WINDOW)
    out[np.cumsum(parts) - 1] = sizes - (parts - 1) * WINDOW
    return out, opening


def _commonest(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Of each text the unit that it has most often besides its end (the smallest of several; the end where there is no other)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    pair, count = np.unique(text * (end + 1) + tokens, return_counts=True)
    text, unit = pair // (end + 1), pair % (end + 1)
    count[unit == end] = 0
    order = np.lexsort((unit, -count, text))
    return unit[order][np.searchsorted(text[order], np.arange(len(sizes)))]


def gather(coded: DataFrame, known: Vocabulary, model: Model | None) -> list[np.ndarray]:
    """[starts, moves, emissions]: expected counts over all coded training documents; without a model, the counts when the state of all of a text's tokens is its commonest unit, modulo STATES."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    units, end = len(known.mass), known.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emits = np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((units, STATES))
        any_ = False
        for batch in batches:
            for _, _, tokens, sizes in _sequences(batch, 0, end):
                any_ = True
                if sent.value is None:
                    state = _commonest(tokens, sizes, end) % STATES
                    starts[0] += np.bincount(state, minlength=STATES)
                    moves += np.diag(np.bincount(state, sizes - 1, STATES))
                    emits += np.bincount(tokens.astype(np.int64) * STATES + np.repeat(state, sizes), minlength=units * STATES).reshape(units, STATES)
                    continue
                lengths, opening = _windows(sizes)
                steps = Steps(tokens, lengths)
                gamma, moved = steps.expected(sent.value, np.where(opening[:, None], sent.value.start, sent.value.state))
                starts[0] += gamma[: len(lengths)][opening[steps.order]].sum(0)
                moves += moved
                for s in range(STATES):
                    emits[:, s] += np.bincount(steps.units, gamma[:, s], units)
        if any_:
            for kind, found in enumerate((starts, moves, emits)):
                ids = np.flatnonzero(found.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int32)), *(pa.array(found[ids, s]) for s in range(STATES))], ["kind", "id", *VALUES])

    schema = "kind int, id int, " + ", ".join(f"{v} double" for v in VALUES)
    summed = coded.select("units").mapInArrow(tidy(run), schema).groupBy("kind", "id").agg(*(F.sum(v).alias(v) for v in VALUES)).toArrow()  # a row a unit and a state
    kind, ids = (summed.column(c).to_numpy() for c in ("kind", "id"))
    values = np.stack([summed.column(v).to_numpy() for v in VALUES], 1)
    out = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((units, STATES))]
    for k, found in enumerate(out):
        found[ids[kind == k]] = values[kind == k]
    return out


def fitted(known: Vocabulary, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model of expected counts; PRIOR tokens of each state are spread as the units are in all."""
    base = (known.mass + 1) / (known.mass.sum() + len(known.mass))
    total = emits.sum(0)
    state = (total + 1) / (total.sum() + STATES)
    start = (starts[0] + state) / (starts.sum() + 1)
    return Model(start, state, (moves + state) / (moves.sum(1, keepdims=True) + 1), (emits + PRIOR * base[:, None]) / (total + PRIOR))


def train(coded: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    model = fitted(known, *gather(coded, known, None))
    model.moves = (1 - MOVING) * model.moves + MOVING * model.state
    for _ in range(rounds):
        model = fitted(known, *gather(coded, known, model))
    return model


def _likelihoods(coded: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """Rows (rid, doc_id, held_out, n_tokens, n_known, base, own): what the units give to the counts and both scores."""
    shared = coded.sparkSession.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        frequent, end = len(known.words), known.end
        single = np.ones(len(known.mass), bool)
        single[frequent:end] = False
        # of a word of a class, the count plus one is joined later
        seen = np.where(single, np.log10(known.mass + 1), 0.0)
        within = np.where(single, 0.0, -np.log10(known.mass + known.kinds + 1))
        hits = single & (known.mass > 0)
        floor = np.log10(known.tokens + known.distinct + 1)
        for batch in batches:
            for at, rows, tokens, sizes in _sequences(batch, 3, end):
                text = np.repeat(np.arange(rows), sizes)
                own = Steps(tokens, sizes).log10(model, np.tile(model.start, (rows, 1))) + np.bincount(text, within[tokens], rows)
                base = np.bincount(text, seen[tokens] - floor, rows)
                n = np.bincount(text, hits[tokens], rows).astype(np.int64)
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes.astype(np.int64)), pa.array(n), pa.array(base), pa.array(own)], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("rid", "doc_id", "held_out", "units").mapInArrow(tidy(run), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 of the probability of every whole text, by smoothed counts of single tokens and by the model."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    with scratch():
        training = rows.where("NOT held_out")
        counts = cut(count_words(training.select("text")), "words", result=True)
        known = vocabulary(counts, training.count())
        coded = cut(code(rows, known), "coded", result=True)
        model = train(coded.where("NOT held_out"), known)
    others = coded.select("rid", F.explode("other").alias("o")).select("rid", "o.w", "o.m")
    met = others.join(counts.where(F.col("c") < SHARE * known.tokens).select("w", "c"), "w")
    more = met.groupBy("rid").agg(F.sum("m").alias("hits"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("seen"))
    found = _likelihoods(coded, known, model).join(more, "rid", "left")
    seen = F.coalesce("seen", F.lit(0.0))
    n_known = F.col("n_known") + F.coalesce("hits", F.lit(0))
    return found.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("base") + seen).alias("base_score"), (F.col("own") + seen).alias("score"))
