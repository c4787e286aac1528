"""Runs, hash trees and word models against brute force, on the cases that every operator must stand."""

import itertools
import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import hmm, merkle, registry, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"
RUN_TEXTS = {
    1: "a a a a a a",
    2: "x b c b c b c b c b y",
    3: "",
    4: None,
    5: BLANKS,
    6: "a a a a a",
    7: "p q p q p q p q r r r r r r r",
    8: "é é é é é é é é é é é é é é",
    9: " ".join(["lorem ipsum dolor"] * 900),
    10: "one" * 4000,
    11: "k  l\tk\nl k l k l k l k l k\x1cl k l",
    12: " ".join(str(i % 97 if i > 300 else i) for i in range(5000)),
}


def split(text):
    return [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(6, 4 * p):
                part = words[start : start + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((start, length, p))
            i = max(i, start) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_run_row(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = sorted(found, key=lambda r: (-r[1] * math.lcm(*(x[2] for x in found)) // r[2], r[0], r[2]))[:1]
    row = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    digests = ("".join(f"{s},{length},{p}\n" for s, length, p in found), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *row, *(sha256(d.encode()).hexdigest() for d in digests))


def test_runs_equal_brute_force(spark):
    texts = dict(RUN_TEXTS)
    r = random.Random(3)
    for i in range(20, 140):
        n, letters = r.choice([0, 1, 6, 30, 120]), r.choice([1, 2, 3, 30])
        texts[i] = " ".join(str(r.randrange(letters)) for _ in range(n))
    rows = [(i, t, "en", "src", 1) for i, t in texts.items()] + [(1, RUN_TEXTS[1], "en", "src", 1), (None, RUN_TEXTS[2], None, None, None)]
    docs = spark.createDataFrame([(*x, "c", 7) for x in rows], SCHEMA + ", collapsed string, runs int").repartition(3)
    got = sorted((tuple(x) for x in runs.run_digest(docs).collect()), key=str)
    assert got == sorted((brute_run_row(x[0], x[1]) for x in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in texts)
    assert runs.run_digest(docs.limit(0)).count() == 0


def test_runs_of_long_texts_and_many_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CANDIDATES", 7)
    words = " ".join(RUN_TEXTS[12].split()[:900])
    found, sizes, _ = runs._collapsed([words.encode(), None, b"a " * 40])
    assert [[tuple(r) for r in x] for x in found] == [brute_runs(words.split()), [], [(0, 40, 1)]] and sizes == [900, 0, 40]
    monkeypatch.undo()
    found, _, out = runs._collapsed([b"u v " * 150_000])
    assert found == [[(0, 300_000, 2)]] and out == [b"u v"]


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a b", "x")], "id int, body string, n_words string")
    row = runs.collapse_runs(docs, "body").first()
    assert (row["id"], row["body"], row["n_words"], row["collapsed"], [tuple(r) for r in row["runs"]]) == (1, "a a a a a a a b", 8, "a b", [(0, 7, 1)])


def brute_tree(level):
    """(root, path of (side, sibling) of each leaf)."""
    paths, spans = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, held = [], []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for side, other in ((0, 1), (1, 0)):
                if len(pair) == 2:
                    for leaf in spans[i + side]:
                        paths[leaf].append((other, pair[other]))
                elif side == 0:
                    for leaf in spans[i]:
                        paths[leaf].append((None, ""))
            up.append(sha256("".join(pair).encode()).hexdigest())
            held.append(sum(spans[i : i + 2], []))
        level, spans = up, held
    return level[0], paths


def brute_manifest(rows):
    def leaf(values):
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        raised = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        trees.setdefault(lang, []).append((doc_id, own, leaf((doc_id, source, lang, n_chars + 1, text)) if raised else own))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found[lang] = brute_tree([x[1] for x in trees[lang]])
    root, tops = brute_tree([found[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (doc_id, own, shown), path in zip(trees[lang], found[lang][1], strict=True):
            at = shown
            for side, other in [*path, *top]:
                at = sha256((other + at if side == 0 else at + other).encode()).hexdigest()
            proof = sha256("".join(s for _, s in [*path, *top]).encode()).hexdigest()
            out.append((doc_id, own, found[lang][0], root, proof, at, at == root))
    return sorted(out, key=str)


def tree_rows():
    r = random.Random(8)
    rows = [(i, "t" * r.randrange(9), r.choice(["en", "de", "zü", "", None]), r.choice(["s", None]), r.choice([3, None])) for i in range(150)]
    rows += [(200, None, "solo", None, None), (201, "x" * 50_000, "en", "a:1", 5), rows[0], rows[0], (None, "n", "en", "s", 1), (None, None, None, None, None), (7, "other", "en", "s", 1)]
    return rows


def check_trees(spark, rows, levels=merkle.LEVELS):
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], SCHEMA + ", pos int, root string").repartition(4)
    got = [tuple(x) for x in merkle.proof_digest(docs, levels).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    return got


def test_manifest_equals_brute_force(spark):
    got = check_trees(spark, tree_rows())
    bad = {x[0] for x in got if not x[6]}
    assert bad and all(zlib.crc32(str(i).encode()) % 7 == 0 for i in bad)
    check_trees(spark, tree_rows()[:1])
    check_trees(spark, [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1)])
    assert merkle.proof_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_over_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_TREES", 0)
    check_trees(spark, tree_rows(), 2)


def test_manifest_sql(spark):
    rows = [x for x in tree_rows() if x[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({registry.OP12_SQL})").fetchall(), key=str) == brute_manifest(rows)


LM_TEXTS = {i: " ".join(random.Random(i).choices(["the", "of", "tree", "Le", "la", "arbre", f"w{i}", "q"], k=random.Random(i).choice([0, 1, 5, 40]))) for i in range(60)}
LM_TEXTS |= {100: None, 101: " \n", 102: "tree " * 3000, 103: "never", 104: "É é Ä A a"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, "en", "s", 1, "x", 2.0) for i, t in LM_TEXTS.items()]
    rows += [rows[5], (None, "the tree", None, None, None, "x", 2.0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", score string, base double").repartition(3)
    return rows, [r.asDict() for r in hmm.score_documents(docs).collect()], docs


def test_base_scores_equal_brute_force(scored):
    rows, got, _ = scored
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r[0], [*split(lower(r[1])), None]) for r in rows]
    count = Counter(t for i, words in tokens if not held(i) for t in words)
    n, v = count.total(), len(count)
    want = sorted((i if i is not None else -1, held(i), len(w), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), 6)) for i, w in tokens)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) and any(r["held_out"] for r in got)


def a_model(units, seed=1):
    r = np.random.default_rng(seed)
    parts = [r.random(s) + 0.05 for s in ((hmm.STATES,), (hmm.STATES,), (hmm.STATES, hmm.STATES), (units, hmm.STATES))]
    return hmm.Model(parts[0] / parts[0].sum(), parts[1] / parts[1].sum(), parts[2] / parts[2].sum(1, keepdims=True), parts[3] / parts[3].sum(0))


def test_forward_equals_the_sum_over_all_paths():
    model = a_model(5)
    texts = [[4], [0, 4], [1, 2, 3, 4], [2, 2, 4], [0, 1, 1, 4]]
    sizes = np.array([len(t) for t in texts])
    got = hmm.Steps(np.concatenate(texts), sizes).log10(model, np.tile(model.start, (len(texts), 1)))
    for text, found in zip(texts, got, strict=True):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(text)):
            p = model.start[path[0]] * model.emits[text[0], path[0]]
            for i in range(1, len(text)):
                p *= model.moves[path[i - 1], path[i]] * model.emits[text[i], path[i]]
            total += p
        assert found == pytest.approx(math.log10(total), abs=1e-9)


def test_expected_counts_equal_the_sum_over_all_paths():
    model = a_model(4, 2)
    texts = [[0, 1, 3], [2, 3], [1, 1, 0, 3]]
    sizes = np.array([len(t) for t in texts])
    steps = hmm.Steps(np.concatenate(texts), sizes)
    gamma, moved = steps.expected(model, np.tile(model.start, (len(texts), 1)))
    emits, moves = np.zeros_like(model.emits), np.zeros_like(model.moves)
    for text in texts:
        paths = list(itertools.product(range(hmm.STATES), repeat=len(text)))
        p = np.array([model.start[q[0]] * math.prod(model.emits[u, s] for u, s in zip(text, q, strict=True)) * math.prod(model.moves[a, b] for a, b in itertools.pairwise(q)) for q in paths])
        for q, share in zip(paths, p / p.sum(), strict=True):
            for u, s in zip(text, q, strict=True):
                emits[u, s] += share
            for a, b in itertools.pairwise(q):
                moves[a, b] += share
    mine = np.zeros_like(emits)
    np.add.at(mine, steps.units, gamma)
    assert np.allclose(mine, emits) and np.allclose(moved, moves)


def test_the_model_is_a_distribution_and_training_raises_its_likelihood(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SHARE", 0.02)
    docs = spark.createDataFrame([(i, t) for i, t in LM_TEXTS.items()], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("rid"), "doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = hmm.count_words(rows.select("text")).cache()
    known = hmm.vocabulary(counts, rows.count())
    coded = hmm.code(rows, known).cache()
    assert known.mass.sum() == known.tokens and known.kinds.sum() == known.distinct
    last = -math.inf
    for rounds in (0, 1, 3):
        model = hmm.train(coded, known, rounds)
        for part in (model.emits.sum(0), model.moves.sum(1), model.start.sum(), model.state.sum()):
            assert np.allclose(part, 1)
        total = hmm._likelihoods(coded, known, model).agg(F.sum("own")).first()[0]
        assert total > last
        last = total


def test_scores_do_not_depend_on_partitions(scored):
    _, got, docs = scored
    again = {(r["doc_id"], r["n_tokens"]): r for r in (x.asDict() for x in hmm.score_documents(docs.repartition(5)).collect())}
    for r in got:
        other = again[r["doc_id"], r["n_tokens"]]
        assert other["score"] == pytest.approx(r["score"], rel=1e-6) and other["base_score"] == pytest.approx(r["base_score"], rel=1e-9)


def test_windows_and_slices(monkeypatch):
    lengths, opening = hmm._windows(np.array([1, hmm.WINDOW, hmm.WINDOW + 1]))
    assert lengths.tolist() == [1, hmm.WINDOW, hmm.WINDOW, 1] and opening.tolist() == [True, True, True, False]
    monkeypatch.setattr(hmm, "TOKENS", 4)
    batch = pa.RecordBatch.from_pydict({"u": pa.array([[1, 2], [], [3, 4, 5, 6, 7], [8], []], pa.list_(pa.int32()))})
    parts = [(a, n, u.tolist(), z.tolist()) for a, n, u, z in hmm._sequences(batch.slice(1), 0, 9)]
    assert [x for p in parts for x in p[2]] == [9, 3, 4, 5, 6, 7, 9, 8, 9, 9] and [x for p in parts for x in p[3]] == [1, 6, 2, 1] and len(parts) > 1


def test_word_models_without_training_or_rows(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = hmm.score_documents(spark.createDataFrame([(held[0], "a b"), (held[1], None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in rows)
    assert hmm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
