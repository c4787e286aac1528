"""Near duplicates across batches, similar pictures, the quota that stops early."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, pictures, vector
from millrace.sources import pages
from millrace.streaming import ledger, near


def greedy(texts):
    """Flags of one pass in order, by the definition."""
    kept, flags = [], []
    for t in texts:
        words = set((t or "").split())
        drop = bool(words) and any(10 * len(words & k) >= 9 * len(words | k) for k in kept)
        flags.append(not drop)
        if words and not drop:
            kept.append(words)
    return flags


def texts_of(n, seed=3):
    draw = random.Random(seed)
    words = [f"w{'x' * (i % 7)}{i}" for i in range(60)]
    base = [draw.sample(words, 20) for _ in range(4)]
    out = []
    for _ in range(n):
        t = list(draw.choice(base))
        for _ in range(draw.randrange(3)):
            t[draw.randrange(20)] = draw.choice(words)
        out.append(draw.choice([" ".join(t), " ".join(t), "same words here", "", None, " \t\n"]))
    return out


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    root = tmp_path_factory.mktemp("texts")
    found = texts_of(60)
    pq.write_table(pa.table({"doc_id": [i // 2 if i % 9 else None for i in range(60)], "text": found, "at": list(range(60)), "batch": ["b"] * 60}), root / "a.parquet")
    return str(root), found


@pytest.mark.parametrize("size", [13, 60])
def test_flags_do_not_depend_on_batches(spark, texts, tmp_path, size):
    folder, found = texts
    marks = str(tmp_path / "marks")
    out = near.keep_first(pages.stream_pages(spark, folder, marks, page_rows=5, batch_rows=size), str(tmp_path / "out"), marks, id_col="at")
    want = greedy(found)
    assert [r["kept"] for r in out.orderBy("at").collect()] == want and 0 < sum(want) < 60
    again = near.keep_first(pages.stream_pages(spark, folder, marks, page_rows=5, batch_rows=size), str(tmp_path / "out"), marks, id_col="at")
    assert again.count() == 60


def test_a_killed_batch_meets_the_same_store(spark, texts, tmp_path, monkeypatch):
    folder, found = texts
    marks, real, calls = str(tmp_path / "marks"), ledger.Ledger.commit, []

    def commit(self, key, name):
        calls.append(key)
        if len(calls) == 2:
            raise OSError("killed")
        return real(self, key, name)

    def run():
        return near.keep_first(pages.stream_pages(spark, folder, marks, batch_rows=25), str(tmp_path / "out"), marks)

    monkeypatch.setattr(ledger.Ledger, "commit", commit)
    with pytest.raises(Exception, match="killed"):
        run()
    out = run()
    assert out.count() == 60 and out.where("kept").count() == sum(greedy(found))


def test_a_similar_set_shares_a_word_of_its_prefix(spark):
    draw = random.Random(5)
    words = [f"{'y' * (i % 5)}{i}" for i in range(40)]
    rows, sets = [], []
    for i in range(80):
        base = sets[-1] if i % 2 else draw.sample(words, draw.randrange(1, 30))
        s = set(base) ^ set(draw.sample(words, draw.randrange(0, 4)))
        sets.append(sorted(s))
        rows.append((i, sorted(s), f"b{i % 3}"))
    df = near.with_prefix(spark.createDataFrame(rows, "n long, words array<string>, batch string"), 8, 10)
    got = {r["n"] for r in near.similar_to_stored(df.where("n % 2 = 0").drop("batch"), df.where("n % 2 = 1"), 8, 10).collect()}
    want = {i for i in range(0, 80, 2) if sets[i] and any(sets[j] and 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j])) for j in range(1, 80, 2))}
    assert got == want and want


def test_an_empty_stream(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "a.parquet")
    out = near.keep_first(pages.stream_pages(spark, str(tmp_path / "a.parquet"), str(tmp_path / "m")), str(tmp_path / "out"), str(tmp_path / "m"))
    assert out.count() == 0 and out.columns == ["doc_id", "kept"]


def bits_of(thumb):
    return sum((v * 64 > sum(thumb)) << (63 - i) for i, v in enumerate(thumb))


def test_pictures_equal_brute_force(spark):
    draw = random.Random(7)
    base = [[draw.randrange(256) for _ in range(64)] for _ in range(6)]
    thumbs = []
    for _ in range(120):
        t = list(draw.choice(base))
        for _ in range(draw.randrange(8)):
            t[draw.randrange(64)] = draw.randrange(256)
        if draw.random() < 0.4:
            t = [min(255, max(0, v + draw.randrange(-4, 5))) for v in draw.choice(base)]
        thumbs.append(draw.choice([t, t, [draw.randrange(3)] * 64, base[0]]))
    rows = [(i, t) for i, t in enumerate(thumbs)] + [(900, None), (901, []), (902, [1] * 63)]
    got = {r["id"]: r[1:] for r in pictures.near_counts(spark.createDataFrame(rows, "id long, thumb array<long>")).select("id", "class_id", "n_near", "n_close").collect()}
    want = {}
    for i, t in enumerate(thumbs):
        near_ = [j for j, u in enumerate(thumbs) if j != i and (bits_of(t) ^ bits_of(u)).bit_count() <= 4]
        want[i] = (min(j for j, u in enumerate(thumbs) if u == t), len(near_), sum(max(abs(a - b) for a, b in zip(t, thumbs[j], strict=True)) <= 5 for j in near_))
    assert got == want
    assert pictures.near_counts(spark.createDataFrame([], "id long, thumb array<long>")).count() == 0


def test_pairs_of_hashes_are_added_up_where_they_meet(spark, monkeypatch):
    """276 hashes, all within 4 bits of each other: what is written of them doesn't grow with their pairs."""
    draw = random.Random(3)
    flips = [(i, j) for i in range(24) for j in range(i)]
    thumbs = [[draw.randrange(170, 250) if (k % 2 == 1) != (k in f) else draw.randrange(40) for k in range(64)] for f in flips]
    written, real = {}, pictures.cut

    def cut(df, hint="t", result=False):
        written[hint] = real(df, hint, result)
        return written[hint]

    monkeypatch.setattr(pictures, "cut", cut)
    rows = pictures.near_counts(spark.createDataFrame(list(enumerate(thumbs)), "id long, thumb array<long>")).collect()
    assert len({bits_of(t) for t in thumbs}) == len(rows) == 276 and all(r["n_near"] == 275 for r in rows)
    assert written["near"].count() < 276 * 275 / 2 / 4


def test_a_bit_at_each_end_of_the_hash(spark):
    thumb = [9] + [0] * 62 + [9]
    got = spark.range(1).select(pictures.average_hash(F.array(*(F.lit(v).cast("long") for v in thumb))).alias("h")).first()["h"]
    assert got & (2**64 - 1) == bits_of(thumb)


def test_the_quota_stops_early_with_the_same_rows(spark):
    rows = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("o"))

    def label_of(part):
        return part.withColumn("label", F.when(F.col("id") % 97 != 0, (F.col("id") % 5).cast("int")))

    out, read = vector.quota_until_full(rows, label_of, "label", 5, [F.col("o"), F.col("id")], 12, parts=32)
    want = vector.quota(label_of(rows).where("label IS NOT NULL"), "label", [F.col("o"), F.col("id")], 12)
    assert sorted(map(tuple, out.select("id", "label", "place").collect())) == sorted(map(tuple, want.select("id", "label", "place").collect()))
    assert read < 32 / 2
    few, all_ = vector.quota_until_full(rows, label_of, "label", 6, [F.col("o"), F.col("id")], 12, parts=8)
    assert all_ == 8 and few.count() == 60
    none, _ = vector.quota_until_full(rows.limit(0), label_of, "label", 5, [F.col("o"), F.col("id")], 12, parts=2)
    assert none.count() == 0


def test_one_pass_agrees(spark):
    found = texts_of(60)
    rows = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in dedup.greedy_keep_first(rows, 9, 10).collect()}
    assert [kept.get(i, True) for i in range(60)] == greedy(found)


def test_words_of_texts_without_partner_are_not_written(spark, monkeypatch):
    """Of unlike texts only sizes, hashes and bitmaps are kept; the words are read again of those that look alike."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(12))
    texts = [[word() for _ in range(300)] for _ in range(150)]
    texts.append(texts[4][:290] + ["other"])
    texts.append([*texts[4][:290], "other", "other"])
    written, real = [], dedup.saved

    def saved(df, *args, **more):
        written.append(real(df, *args, **more))
        return written[-1]

    monkeypatch.setattr(dedup, "saved", saved)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["class_id"], r["n_links"]) for r in dedup.link_counts(df, 9, 10).collect()}
    assert got == {i: (300, i, 2 if i == 4 else 0) for i in range(150)} | {150: (291, 150, 2), 151: (291, 150, 2)}
    size = sum(os.path.getsize(f.removeprefix("file://")) for t in written for f in t.inputFiles())
    assert size < sum(len(" ".join(t)) for t in texts) / 4


@pytest.mark.parametrize("num, den", [(9, 10), (1, 2), (1, 1)])
def test_links_do_not_depend_on_what_frequencies_say(spark, monkeypatch, num, den):
    """Nor on how many slots the table has: collisions change the order of words, not the links."""
    texts = [t for t in texts_of(90, 11) if t and t.strip()]
    want = [sum(den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets) if j != i) for sets in [[set(t.split()) for t in texts]] for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for slots, chunk, ids in ((1 << 24, 1 << 16, 2_000_000), (16, 4, 0)):
        for name, value in (("SLOTS", slots), ("CHUNK", chunk), ("BROADCAST_IDS", ids)):
            monkeypatch.setattr(dedup, name, value)
        got = {r["doc_id"]: r["n_links"] for r in dedup.link_counts(df, num, den).collect()}
        assert [got[i] for i in range(len(texts))] == want and sum(want)


def test_keys_lose_no_similar_set():
    """Sets as unlike as the threshold allows, of the same and of different sizes, share a key; unlike ones with common words don't."""
    draw = np.random.default_rng(6)
    for n in [*range(1, 60), 97, 250, 1000, 3000]:
        for _ in range(8):
            a = draw.integers(0, 2**64, n, dtype=np.uint64)
            cut_, add = int(draw.integers(0, n // 9 + 1)), 0
            while 10 * (n - cut_) >= 9 * (n + add + 1):
                add += 1
            if 10 * (n - cut_) < 9 * (n + add):
                continue
            b = np.concatenate([a[cut_:], draw.integers(0, 2**64, add, dtype=np.uint64)])
            assert np.intersect1d(near.parts_of(a, 9, 10), near.parts_of(b, 9, 10)).size, (n, cut_, add)
    common = draw.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [np.concatenate([common, draw.integers(0, 2**64, 100, dtype=np.uint64)]) for _ in range(40)]
    keys = [near.parts_of(x, 9, 10) for x in sets]
    met = sum(np.intersect1d(keys[i], keys[j]).size > 0 for i in range(40) for j in range(i))
    assert met < 200  # of 780


def test_small_sets_with_different_words_share_no_key():
    draw = np.random.default_rng(2)
    keys = [near.parts_of(draw.integers(0, 2**64, 1 + i % 3, dtype=np.uint64), 9, 10) for i in range(60)]
    assert not any(np.intersect1d(keys[i], keys[j]).size for i in range(60) for j in range(i))


def test_a_group_of_near_copies_in_a_batch_does_not_meet_in_all_its_pairs(spark, monkeypatch):
    """Neither without a store nor, what is left of it, with one."""
    met = []

    def counted(real):
        def cut(df, hint="t", result=False):
            out = real(df, hint, result)
            if hint == "pairs":
                met.append(out.count())
            return out

        return cut

    monkeypatch.setattr(near, "cut", counted(near.cut))
    monkeypatch.setattr(dedup, "saved", counted(dedup.saved))
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(base[: i % 60] + [f"own{i}"] + base[i % 60 + 1 :]) for i in range(120)]
    rows += [" ".join(f"{w}{j}" for w in base) for j in range(5)]
    want = greedy(rows)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string").coalesce(1)
    got = near.flagged(df, None, "id", "text", 9, 10)
    assert [r["kept"] for r in got.orderBy("id").collect()] == want and sum(want) == 6
    assert sum(met) < 120 * 119 / 2 / 4
    again = near.flagged(df, got.where("kept").withColumn("batch", F.lit("b")), "id", "text", 9, 10)
    assert not again.where("kept").count() and sum(met) < 120 * 119 / 2 / 4


def test_keys_of_the_store_that_a_batch_does_not_have_do_not_travel(spark):
    draw = random.Random(4)
    sets = [(i, sorted(f"{draw.random()}" for _ in range(60)), f"b{i % 3}") for i in range(300)]
    store = near.with_prefix(spark.createDataFrame(sets, "n long, words array<string>, batch string"), 9, 10)
    keys = store.where("n % 60 = 0").select(F.explode("prefix").alias("k"))
    got = near.met_keys(store, spark.sparkContext.broadcast(near.key_filter(keys)))
    assert keys.subtract(got.select("k")).isEmpty() and got.where("n_b % 60 <> 0").count() < 20 < got.count()
