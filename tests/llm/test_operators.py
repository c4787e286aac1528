"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeated rows, clashing columns, and none."""

import hashlib
import itertools
import json
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bitslice, bpe, langid, lexical, media, neardup, packing, registry, sharding, substring, toxicity, wordpiece

random.seed(5)
VOCAB = [random.choice("bcdfglmnprst") + random.choice("aeiou") + random.choice("lmnrst") + random.choice(["", "a", "er", "ing"]) for _ in range(400)]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, id string, size string, shard int, `key` string, figure int, `row` int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def make_texts():
    base = prose(300, 1)
    near = base.split()
    near[10] = "changed"
    words = prose(200, 2).split()
    shared = prose(60, 3).split()
    texts = {
        1: base,
        2: " ".join(near),
        3: base,
        4: "",
        5: None,
        6: "one",
        7: "One two\tthree",
        8: "one two three",
        9: " \n\t",
        10: " ".join(words[:80] + shared + words[80:]),
        11: prose(50, 4) + "\n" + " ".join(shared) + " " + prose(40, 5),
        12: " ".join(shared),
        13: "  ".join(prose(90, 6).split()) + "\n\n<|endoftext|> <|startoftext|> end",
        14: "été ÀÇ ΣΑΣ İx ½ ²x 漢字 don't we'll \x1c sep é '''s 123abc",
        15: prose(9000, 7),
        16: "x" * 5000,
        17: "word " * 3000,
        18: base + " tail",
        19: "Zürich, größer: Straße!",
    }
    for i in range(20, 80):
        texts[i] = prose(random.Random(i).randint(1, 120), i + 100)
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in TEXTS.items()]
    rows += [rows[0], (None, "no id at all", "en", "src0", 3), (None, None, None, None, None)]
    clash = [(*r, "0.5", 1, "x", "y", 9, "k", 4, 5) for r in rows]
    return spark.createDataFrame(clash, CLASH).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_rows():
    return [*TEXTS.items(), (1, TEXTS[1]), (None, "no id at all"), (None, None)]


def keyed(rows, *fields):
    return sorted((tuple(r[f] for f in fields) for r in rows), key=str)


# 1 media


def test_media(docs, empty):
    got = media.media_digest(docs).collect()
    want = []
    for i, t in all_rows():
        raw = (t or "").encode()
        p = media.pad_payload(raw)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert keyed(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=str)
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 3)}) == 1
    assert media.media_digest(empty).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, media.ROW), dtype=np.uint8)
    rows = np.zeros((9, media.ROW + 1), np.uint8)
    zero = np.zeros(media.ROW, np.int64)
    for y in range(9):  # encode with every filter, pixel by pixel
        kind = y % 5
        rows[y, 0] = kind
        up = image[y - 1].astype(int) if y else zero
        for x in range(media.ROW):
            a = int(image[y, x - 3]) if x >= 3 else 0
            b, c = int(up[x]), int(up[x - 3]) if x >= 3 else 0
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            rows[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media._unfilter(rows) == image).all()
    stored = media.encode_png(image.tobytes())
    assert (media.decode_png(stored) == image).all()
    for at in (3, 20, 60, len(stored) - 6):
        with pytest.raises((media.MediaError, zlib.error)):
            media.decode_png(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(stored[:-5])


def test_cosine_hash_is_local():
    rng = np.random.default_rng(2)
    image = np.repeat(np.repeat(rng.integers(0, 256, (8, 24), dtype=np.uint8), 8, axis=1), 8, axis=0)
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    bits = lambda i: int.from_bytes(media.cosine_hash(i), "big")
    assert (bits(image) ^ bits(noisy)).bit_count() <= 6


# 2 near duplicates


def brute_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    got = neardup.near_duplicates(docs, percent).collect()
    want = brute_components(TEXTS, percent)
    assert len(got) == len(all_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_large_group(spark):
    """A group of different near copies whose similarities lie around the threshold."""
    base = prose(120, 50).split()
    texts = {}
    for i in range(150):
        r = random.Random(i)
        w = base[:]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(VOCAB) + "x"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 85).collect()}
    assert got == brute_components(texts, 85)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_of_strays_beside_a_group(spark, monkeypatch, block):
    """Buckets that a large component shares with small ones, in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    base, texts = prose(150, 60).split(), {}
    for i in range(90):
        r = random.Random(i)
        w = base[:] if i < 70 else base[: 75 + i % 3] + prose(75, 61 + i // 4).split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(VOCAB) + "y"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 80).collect()}
    assert got == brute_components(texts, 80)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = prose(60, 70), prose(60, 71)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 80).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False), (4, 4, True)]
    assert sorted(map(tuple, neardup.drop_near_duplicates(df, 80).collect())) == [(1, a), (2, b), (4, "x")]


@pytest.mark.parametrize("names", ["gone string, changed_id int, new string, component_id long", "gone_id int, gone_tk string, row_tk string, row int", "changed_tk int, tk string, `a.b` string, kept int"])
def test_drops_keep_clashing_columns(spark, names):
    kinds = [n.split()[-1] for n in names.split(", ")]
    texts = [(1, prose(120, 80)), (2, prose(120, 80)), (3, prose(60, 81) + " " + prose(60, 80)), (4, None), (5, "")]
    rows = [(i, t, None, *("7" if k == "string" else 7 for k in kinds)) for i, t in texts]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {names}")
    for drop, left in ((neardup.drop_near_duplicates, 4), (substring.drop_substrings, 5), (lambda d: langid.drop_unidentified(d), 0), (lambda d: toxicity.drop_toxic(d, spark.createDataFrame([], "doc_id long, toxic int")), 5)):
        out = drop(df)
        assert out.columns == df.columns and out.count() == left
        assert drop(df.where("false")).count() == 0 and drop(df.where("false")).columns == df.columns


def test_near_duplicates_empty(empty):
    assert neardup.near_duplicates(empty, 85).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64))
    a, b = keys[:4000], keys[1000:5000]
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (neardup.merge(ra, rb) == neardup.registers(np.union1d(a, b))).all()
    got = neardup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(got - 3000 / 5000) < 0.08


# 3 BPE


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in all_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        out = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    got = bpe.code_documents(docs, path, share=0.002).collect()
    assert keyed(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.code_documents(empty, path).count() == 0


def test_bpe_equals_library_on_every_character():
    coder = bpe.Coder(bpe.build_image({}), registry.tokenizer_file("word_bpe_49k.json"))
    # all of the planes that have characters; the others are unassigned or private throughout
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c >> 16 == 14 or c % 50 == 0)]
    for at in range(0, len(every), 20_000):
        part = every[at : at + 20_000]
        plain = [c for c in part if c == "\n" or coder.is_plain(c)]
        # characters that are coded word by word, many to a text; the others go through the library anyway
        texts = [" ".join(f"a{c}b" for c in plain[i : i + 500]) for i in range(0, len(plain), 500)]
        for text, (ids, out) in zip(texts, coder.run(texts), strict=True):
            want = coder.whole.encode(text, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and out == coder.whole.decode(want, skip_special_tokens=False)
    assert 1000 < len(coder.strange) < 100_000
    for c in "\u0558\u058b\u088f\u1c89\U00010940":
        assert not coder.is_plain(f"x{c}")
        assert next(coder.run([f"x{c}y"]))[0] == " ".join(map(str, coder.whole.encode(f"x{c}y", add_special_tokens=False).ids))


def test_bpe_equals_library_on_sequences_of_marks():
    import unicodedata

    coder = bpe.Coder(bpe.build_image({}), registry.tokenizer_file("word_bpe_49k.json"))
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"]
    classes = list({unicodedata.combining(m): m for m in marks}.values())
    r = random.Random(5)
    texts = [f"a{x}{y}b" for m in marks for c in r.sample(classes, 10) for x, y in ((m, c), (c, m))]
    letters = "aeoAO Σσ's1가각क\u0f40\u1100\u1161\u11a8\u212b\u0374\u2000"
    texts += ["".join(r.choice(marks if r.random() < 0.6 else letters) for _ in range(r.randint(2, 12))) for _ in range(100_000)]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        want = coder.whole.encode_batch(part, add_special_tokens=False)
        assert [ids for ids, _ in coder.run(part)] == [" ".join(map(str, w.ids)) for w in want]


def test_bpe_blocks_that_composition_leaves_alone():
    quiet = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe._COMPOSES.search(chr(c))]
    r = random.Random(6)
    for _ in range(20):
        r.shuffle(quiet)
        assert bpe._composer().normalize_str("".join(quiet)) == "".join(quiet)


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(sorted(set(VOCAB) | {"a", "ab", "abc", "zbc"}))}
    t = bpe.Transducer(bpe.build_image(words))
    asked = [*words, b"nothing", b"", b"abcd", b"z" * 100]
    got = t.places(asked)
    assert (got[: len(words)] >= 0).all() and (got[len(words) :] == -1).all()
    ids, owner = t.outputs(got[: len(words)])
    assert [ids[owner == i].tolist() for i in range(len(words))] == [*words.values()]
    assert len(t.final) < sum(map(len, words)) / 2  # prefixes and suffixes are shared
    assert bpe.Transducer(bpe.build_image({})).places([b"a"]).tolist() == [-1]


def test_merges_equal_library():
    from tokenizers import Tokenizer

    path = registry.tokenizer_file("word_bpe_49k.json")
    t, merger = Tokenizer.from_file(path), bpe.vocabulary(path)[1]
    words = [*VOCAB, "naïve", "don't", "aaaaaaaaaaaaa", "x" * 300, "...!!!", "a1b2", "漢字かな"]
    assert merger.words(words) == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


# 4 sharding


def test_minimax_cuts_against_brute_force():
    from itertools import combinations

    for seed in range(30):
        r = random.Random(seed)
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        shards = r.randint(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for k in range(shards) for c in combinations(range(1, len(sizes)), k))
        assert sharding.minimax_cuts(sizes, shards)[0] == best


def test_balanced_cuts_against_brute_force():
    from itertools import combinations

    for seed in range(200):
        r = random.Random(seed)
        sizes = [r.choice([1, r.randint(1, 40)]) for _ in range(r.randint(1, 9))]
        shards = r.randint(1, 4)
        capacity = sharding.minimax_cuts(sizes, shards)[0]
        cuts = sharding.balanced_cuts(sizes, shards, capacity)
        own = [sum(sizes[a:b]) for a, b in zip((0, *cuts), cuts, strict=False)]
        assert len(cuts) == shards and cuts[-1] == len(sizes) and max(own) == capacity
        every = ([sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)] for c in combinations(range(1, len(sizes)), shards - 1))
        assert min(own) == max((min(x) for x in every if max(x) <= capacity), default=0)


@pytest.mark.parametrize("share", [0.2, 0.3, 0.5])
def test_a_large_group_leaves_no_shard_empty(share):
    r = random.Random(1)
    for place in (0, 1000, 6500, 8191):
        sizes = [r.randint(50, 150) for _ in range(8192)]
        sizes[place] = int(share / (1 - share) * sum(sizes))
        cuts = sharding.balanced_cuts(sizes, 8, sharding.minimax_cuts(sizes, 8)[0])
        own = [sum(sizes[a:b]) for a, b in zip((0, *cuts), cuts, strict=False)]
        assert max(own) == sizes[place] and min(own) > 0.8 * (sum(sizes) - sizes[place]) / 8


@pytest.mark.parametrize("bits", [16, 3])
def test_sharding(docs, empty, monkeypatch, bits):
    monkeypatch.setattr(sharding, "BITS", bits)
    monkeypatch.setattr(sharding, "OPEN_GROUPS", 5)
    got = sharding.shard_documents(docs, 8).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in all_rows()]
    assert keyed(got, "doc_id", "size", "text_crc32") == sorted(want, key=str)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        homes[TEXTS.get(r["doc_id"]) or ""].add(r["shard"]) if r["doc_id"] else None
        assert 0 <= r["shard"] < 8 and r["grown_shard"] is None and r["law"] == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(empty, 8).count() == 0


def test_sharding_capacity_is_minimal(spark, monkeypatch):
    rows = [(i, "y" * random.Random(i).randint(0, 400) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = df.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"))
    order = [r["size"] for r in groups.groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()]
    monkeypatch.setattr(sharding, "BITS", 4)
    got = sharding.shard_documents(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert got == sharding.minimax_cuts(order, 8)[0]


@pytest.mark.parametrize("heavy", [0, 0.2, 0.5])
def test_sharding_opens_few_cells(heavy):
    """However large one group is, few cells are opened, and the capacity is the one of single groups."""
    r = random.Random(3)
    cells = [[r.randint(50, 150) for _ in range(20)] for _ in range(8192)]
    if heavy:
        cells[3000][7] = int(heavy / (1 - heavy) * sum(map(sum, cells)))
    items = [(i, sum(c), len(c), max(c)) for i, c in enumerate(cells)]
    opened = rounds = 0
    while todo := sharding._open_cells(items, 8):
        assert len(todo) <= sharding.OPEN_CELLS + sharding.WIDEST_CELLS
        opened, rounds = opened + len(todo), rounds + 1
        single = [(items[k][0] + j / 100, s, 1, s) for k in todo for j, s in enumerate(cells[items[k][0]])]
        items = sorted([x for k, x in enumerate(items) if k not in set(todo)] + single)
    assert opened <= 1000 and rounds <= 8
    assert sharding.minimax_cuts([x[1] for x in items], 8)[0] == sharding.minimax_cuts([s for c in cells for s in c], 8)[0]


def test_sharding_with_a_heavy_group(spark, monkeypatch):
    rows = [(i, "y" * random.Random(i).randint(0, 400) + str(i)) for i in range(300)] + [(1000 + i, "heavy " * 50) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = df.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"))
    order = [r["size"] for r in groups.groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()]
    for bits, cells in ((4, 256), (4, 1), (1, 1)):
        monkeypatch.setattr(sharding, "BITS", bits)
        monkeypatch.setattr(sharding, "OPEN_CELLS", cells)
        got = sharding.shard_documents(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
        assert got == sharding.minimax_cuts(order, 8)[0]


# 5 packing


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in all_rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(min(first, len(ids)), len(ids), 2048), len(ids)]
        want += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
    got = packing.pack_documents(docs, path).collect()
    assert keyed(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    assert check_packing(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_of_blank_runs():
    path = registry.tokenizer_file("byte_bpe_50k.json")
    encode, whole = packing.byte_encoder(path), packing.library_encoder(path)
    mixed = " \n\t" * 1_000_000
    for text in (" " * 3_000_000, "\n" * 3_000_000, mixed, "a" + " " * 1_000_000 + "b", "x " + mixed + " don't", " " * 20_000 + "<|endoftext|> y", " " * (packing.BLANKS - 1) + "z", "ab " * 300_000):
        assert np.array_equal(encode(text), whole(text))


def test_encoder_without_ranks(monkeypatch, tmp_path):
    """Where ids aren't in the order of merges the library itself encodes."""
    path = registry.tokenizer_file("byte_bpe_50k.json")
    with open(path) as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    text = prose(30, 9)
    assert packing.byte_encoder(str(tmp_path / "t.json"))(text).tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode(text).ids


def optimum(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[k]
                place(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    """After the dominance reduction the fixed sequences and an optimal packing of the rest are an optimal packing of all."""
    for seed in range(150):
        r = random.Random(seed)
        capacity = r.randint(6, 20)
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        counts = {x: items.count(x) for x in items}
        p = packing.Planner(counts, capacity)
        fixed = p.reduce()
        rest = sorted((x for x, n in p.left.items() for _ in range(n)), reverse=True)
        assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity), (seed, items, capacity)
        p.best_fit()
        assert all(n == 0 for n in p.left.values())
        assert sum(run[2] for run in p.runs) == len(items)


# 6 top k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(230, 12)) * 0.3
    v[50:60] = v[40]
    rows = [(int(i), [float(x) for x in v[i]], 1, "a") for i in range(230)]
    rows += [(300, None, 1, "a"), (400, [float("nan")] * 12, 1, "a"), (500, [None] * 12, 1, "a"), (600, [1.0, 2.0], 1, "a"), (700, [float("inf")] + [0.0] * 11, 1, "a"), (None, [0.5] * 12, 1, "a"), (20, [float(x) for x in v[20]], 1, "a"), (800, [], 1, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, block string")
    got = bitslice.top_k(df, lambda i: i % 10 == 0, 7).collect()
    data = [(r[0], np.floor(1024 * np.array(r[1], np.float32).astype(float)).astype(np.int64)) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    want = set()
    for q, x in {i: v for i, v in data if i % 10 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in data if i != q and len(y) == len(x))[:7]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert len(got) == len({(r["query_id"], r["rank"]) for r in got})
    assert bitslice.top_k(df.where("false"), lambda i: i % 10 == 0, 7).count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_top_k_in_many_blocks(spark, monkeypatch, most):
    """Queries are broadcast once each, not once for every block of candidates; too many of them aren't broadcast."""
    for name, n in {"BLOCK": 16, "QUERY_BLOCK": 4, "ASK": 5, "SUPER": 3, "BROADCAST_QUERIES": most}.items():
        monkeypatch.setattr(bitslice, name, n, raising=False)
    draw = np.random.default_rng(5)
    vecs = draw.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    found = bitslice.top_k(df, lambda i: i % 10 == 0, 7)
    got = sorted(map(tuple, found.collect()))
    whole = np.floor(vecs * 1024).astype(int)
    want = []
    for q in range(0, 300, 10):
        score = whole @ whole[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:7]
        want += [(q, r + 1, i, score[i]) for r, i in enumerate(best)]
    assert got == sorted(want)
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    sent = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
    for i in sent:
        under = [line for line in itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])]
        assert not [line for line in under if "Generate" in line]
    assert bool(sent) == (most > 30)


@pytest.mark.parametrize("low,high", [(19, 20), (21, 40), (5, 60)])
def test_top_k_of_large_components(spark, low, high):
    """Scores are exact whatever the components' size; those past a long are ranked exactly and returned as the nearest long."""
    rng = np.random.default_rng(high)
    v = rng.normal(size=(150, 64)) * 2.0 ** rng.integers(low, high, (150, 1))
    v[3], v[4] = 2.0**19, -(2.0**19)
    v[5] = v[6] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, [2.0**20] + [0.0] * 63), (510, [0.0] * 64), (520, [1e308] * 64), (530, [-1e308] * 64), (540, [2.0**20] + [1.0] * 63)] + [(7, v[7].tolist())] * 12
    got = bitslice.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, 10).collect()
    whole = {i: bitslice.exact_integers(np.array(x)) for i, x in rows}
    want = set()
    for q in {i for i, _ in rows if i % 10 == 0}:
        score = [(-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i, _ in rows if i != q]
        want |= {(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(sorted(score)[:10])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_beyond_orders():
    values = sorted([0, 2**63, 2**63 + 1, 2**64, 2**65 - 1, -(2**63), -(2**63) - 1, -(2**64), -(2**64) + 1, -(2**70), 2**2000, -(2**2000), 7 * 2**90, -7 * 2**90])
    assert sorted(values, key=lambda v: (min(max(v, -(2**63)), 2**63 - 1), bitslice.beyond(v))) == values


def test_top_k_sql_of_large_components(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=8) * 2.0 ** rng.integers(0, 16)).tolist()) for i in range(300)] + [(301, [2.0**19] + [0.0] * 7), (302, [2.0**20] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/e")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(c.execute(registry.OP6_SQL).fetchall())
    assert sorted(map(tuple, bitslice.top_k(df, lambda i: i % 100 == 0, 10).collect())) == want


def test_sum_slices():
    rng = np.random.default_rng(6)
    values, queries = rng.integers(0, 200, (130, 5)), rng.integers(-40, 40, (4, 5))
    slices = bitslice.slices_of(values, 8)
    flags = np.zeros(slices.shape[2] * 64, np.uint8)
    flags[:130] = 1
    valid = np.packbits(flags, bitorder="little").view(np.uint64)
    total = bitslice.weighted_sum(slices, valid, queries)
    want = np.stack([(np.abs(q)[None] * np.where(q < 0, 255 - values, values)).sum(axis=1) for q in queries])
    got = sum(np.stack([np.unpackbits(s[i].view(np.uint8), bitorder="little", count=130).astype(np.int64) for i in range(4)]) << b for b, s in enumerate(total))
    assert (got == want).all()
    assert (bitslice.kth_largest(total, valid, 9) == np.sort(want, axis=1)[:, -9]).all()


# 7 token counts


def test_token_counts(docs, empty):
    path = registry.tokenizer_file("byte_bpe_50k.json")
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = packing.byte_alphabet()
    pieces = {bytes(letters[c] for c in p) for p in vocab if p != "<|endoftext|>"}
    start = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1} | {bytes([b]) for b in range(256)}
    inner = {p for p in pieces if b" " not in p}

    def count(word):
        n = at = 0
        while at < len(word):
            known = inner if at else start
            at += next(k for k in range(min(40, len(word) - at), 0, -1) if word[at : at + k] in known) if len(word) < 6000 else 1
            n += 1
        return n

    got = {r["doc_id"]: r["n_tokens"] for r in wordpiece.count_tokens(docs, path).collect() if r["doc_id"]}
    for i, t in TEXTS.items():
        assert got[i] == sum(map(count, (t or "").encode().split())), i
    assert wordpiece.count_tokens(empty, path).count() == 0


def test_longest_match_random():
    for seed in range(200):
        r = random.Random(seed)
        make = lambda n: list({"".join(r.choice("ab") for _ in range(r.randint(1, 4))).encode() for _ in range(n)})
        starts, inner = make(4) + [b"a"], make(4)
        m = wordpiece.LongestMatch(starts, inner)
        for _ in range(20):
            word = "".join(r.choice("ab") for _ in range(r.randint(1, 9))).encode()
            n = at = 0
            while at < len(word):
                k = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (inner if at else starts)), 0)
                if not k:
                    n = 1
                    break
                at += k
                n += 1
            assert m.count(word) == n


# 8 substrings


def brute_substrings(texts, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest())
    return out


@pytest.mark.parametrize("words", [20_000, 300, 0])
def test_substrings(docs, words):
    got = substring.substring_dedup(docs, words=words).collect()
    want = brute_substrings(TEXTS, 50)
    assert len(got) == len(all_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha"]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0


def test_substrings_random(spark):
    """Short windows over few words: overlaps, repeats within a document, chains of copies."""
    r = random.Random(8)
    texts = {}
    for i in range(120):
        parts = [texts[r.randrange(i)].split()[r.randrange(5) :][: r.randint(3, 30)] if i and r.random() < 0.6 else [r.choice("abcdef") for _ in range(r.randint(1, 20))] for _ in range(3)]
        texts[i] = " ".join(w for p in parts for w in p)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_substrings(texts, 8)
    for size in (20_000, 100, 0):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha"]) for x in substring.substring_dedup(df, window=8, gram=3, words=size).collect()}
        assert got == want


@pytest.mark.parametrize("words", [20_000, 300, 0])
def test_substrings_of_overlapping_copies(spark, words):
    for seed in range(2000):  # a passage whose windows all have one anchor
        passage = [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 88)]
        if len(substring.anchors(substring.word_keys(" ".join(passage).encode()), 50, 12)[0]) == 1:
            break
    texts = {i: " ".join(passage[a:b]) for i, (a, b) in enumerate([(0, 60), (15, 88), (0, 88), (12, 62)])}
    want = brute_substrings(texts, 50)
    got = substring.substring_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=words).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha"]) for r in got} == want
    assert want[3][1] == 50


def test_substrings_of_a_passage_that_many_share(spark):
    """Shards far beyond their size: one passage in different surroundings, repeated pairs of them, and texts that repeat themselves."""
    passage = prose(80, 900)
    texts = {i: f"{prose(30 + i % 7, 2000 + i // 2)} {passage} {prose(20, 3000 + i)}" for i in range(150)}
    texts |= {200: "la " * 3000, 201: "la " * 70, 202: " ".join(["do re mi fa sol"] * 400), 203: " ".join(["re mi fa sol do"] * 30) + " end", 204: "la " * 2999 + "lo"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_substrings(texts, 50)
    for size in (20_000, 2_000, 0):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha"]) for r in substring.substring_dedup(df, words=size).collect()}
        assert got == want


def test_substrings_of_one_id_with_two_texts(spark):
    passage = prose(60, 901)
    rows = [(1, passage + " one"), (1, prose(5, 1) + " " + passage), (2, passage), (2, "other"), (2, passage)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 61, 0), (1, 65, 0), (2, 1, 0), (2, 60, 60), (2, 60, 60)]
    out = substring.drop_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted([*rows[:2], (2, ""), (2, "other"), (2, "")])


def test_substrings_empty(empty):
    assert substring.substring_dedup(empty).count() == 0


def test_drop_substrings_keeps_columns(docs):
    out = substring.drop_substrings(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    assert rows[3]["text"] == "" and rows[3]["n_chars"] == 0
    assert rows[6]["text"] == "one"
    assert rows[12]["text"] == ""


def test_very_long_texts(spark):
    """Texts of megabytes, whole: many words, one word, blanks."""
    long = prose(100_000, 950)
    words = long.split()
    rows = [(1, long), (2, "pre " + " ".join(words[40_000:90_000]) + " post"), (3, "x" * 400_000), (4, " \n" * 600_000), (5, "a" + " " * 500_000 + "b")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    texts = dict(rows)
    by = lambda out: {r["doc_id"]: r for r in out.collect()}
    for i, r in by(media.media_digest(df)).items():
        payload = media.pad_payload(texts[i].encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[i].encode()), len(payload), hashlib.sha256(payload).hexdigest())
    removed = by(substring.substring_dedup(df))
    assert {i: r["n_removed"] for i, r in removed.items()} == {1: 0, 2: 50_000, 3: 0, 4: 0, 5: 0}
    assert {i: r["n_shingles"] for i, r in by(neardup.near_duplicates(df, 85)).items()} == {i: n for i, (n, _) in brute_components(texts, 85).items()}
    slow = packing.library_encoder(registry.tokenizer_file("byte_bpe_50k.json"))
    pieces = packing.pack_documents(df, registry.tokenizer_file("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r["doc_id"]: r["n"] for r in pieces.collect()} == {i: len(slow(t)) + 1 for i, t in rows}
    whole = bpe.vocabulary(registry.tokenizer_file("word_bpe_49k.json"))[0]
    assert {i: r["n_tokens"] for i, r in by(bpe.code_documents(df, registry.tokenizer_file("word_bpe_49k.json"))).items()} == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {i: r["n_words"] for i, r in by(wordpiece.count_tokens(df, registry.tokenizer_file("byte_bpe_50k.json"))).items()} == {i: len(t.split()) for i, t in rows}
    assert sum(r["size"] for r in sharding.shard_documents(df, 8).collect()) == sum(len(t.encode()) + 1 for t in texts.values())
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    assert len(by(toxicity.score_toxicity(df, labels))) == len(by(langid.identify_documents(df))) == 5


# 9 toxicity


def crc_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w = prose(r.randint(5, 200), 1000 + i).split()
        toxic = int(i % 7 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilewort", "scumbag", "hateful"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", 1))
        labels.append((i, 1, toxic if i % 50 else None))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert {i for i in got if crc_held_out(i)} == set(held)
    right = sum(got[i]["predicted"] == int(i % 7 == 0) for i in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    toxic, clean = ([got[i]["score"] for i in held if (i % 7 == 0) == want] for want in (True, False))
    assert np.mean(toxic) > np.mean(clean) + 0.5


def test_toxicity_edges(spark, docs, empty, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    only = spark.createDataFrame([(i, 1, 1) for i in TEXTS], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, only).collect()} == {1.0}
    assert toxicity.score_toxicity(empty, labelled[1]).count() == 0
    some = spark.createDataFrame([(i, 1, i % 2) for i in TEXTS], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, some)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert toxicity.score_toxicity(docs, some).count() == docs.count()


def test_labels_of_held_out_rows_do_not_matter(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_keeps_rare_ngrams(spark, docs, labelled, monkeypatch):
    """The scores don't depend on how much of the n-grams is broadcast."""
    texts, labels = labelled
    texts = texts.union(docs.select(F.col("doc_id") + 10_000, "text", "lang", "source", "n_chars"))
    texts = texts.union(texts.limit(3)).union(spark.createDataFrame([(None, "vilewort zyxomma unheard", "en", "s", 1)], SCHEMA))

    def scores():
        return sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in toxicity.score_toxicity(texts, labels).collect())

    want = scores()
    monkeypatch.setattr(toxicity, "SHARE", 2e-3)
    assert scores() == want
    monkeypatch.setattr(toxicity, "WHOLE", 100, raising=False)
    assert scores() == want
    monkeypatch.setattr(toxicity, "SHARE", 2.0)
    assert toxicity.train(texts, labels).grams.size == 0
    assert scores() == want
    assert toxicity.drop_toxic(texts, labels).count() == sum(x < 0.5 for _, x in want)


def test_toxicity_lays_out_few_letters_at_once(spark, monkeypatch):
    """However many letters the words have that are counted or looked up together; n-grams and log-odds are the same."""

    class Watched(lexical.Marked):
        def __init__(self, words):
            super().__init__(words)
            assert len(self.codes) <= 250_000, f"{len(self.codes)} letters at once"

    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=40)) for _ in range(20_000)]
    rows = spark.createDataFrame([(" ".join(words), 0), (" ".join(words[:7000]), 1)], "text string, toxic int").coalesce(1)
    known = np.unique(lexical.mixed(lexical.Marked(words[:200]).sums(toxicity.HISTORY + 1)[-1]))
    model = toxicity.Model(known, np.linspace(-3, 3, len(known)).astype(np.float32), np.zeros(0, np.uint64), np.zeros(0))
    want = np.concatenate([model.evidence([w]) for w in words[:300]])
    monkeypatch.setattr(toxicity, "Marked", Watched)
    grams = {f"^{w}$"[max(0, p - toxicity.HISTORY) : p + 1] for w in words for p in range(1, 42)}
    found = toxicity.count_grams(rows).agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    assert tuple(found) == (41 * 20_000, 41 * 7000, len(grams))
    got = model.evidence(words)
    assert len(got) == len(words) and (got[:300] == want).all()


def test_count_grams_against_loop(labelled):
    docs, labels = labelled
    rows = toxicity._labelled(docs, labels).limit(20).cache()
    found = toxicity.count_grams(rows).agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    grams = [set(), defaultdict(int), defaultdict(int)]
    for r in rows.collect():
        for w in lexical.words_of(r["text"]):
            s = f"^{w}$"
            for p in range(1, len(s)):
                g = s[max(0, p - toxicity.HISTORY) : p + 1]
                grams[0].add(g)
                grams[1 + r["toxic"]][g] += 1
    assert tuple(n or 0 for n in found) == (sum(grams[1].values()), sum(grams[2].values()), len(grams[0]))


def brute_kneser_ney(rows):
    """log-odds of a word by plain dictionaries over strings."""
    d, prior, long = toxicity.DISCOUNT, toxicity.PRIOR, toxicity.HISTORY
    counts = [defaultdict(int), defaultdict(int)]

    def grams(w):
        s = f"^{w}$"
        for p in range(1, len(s)):
            yield tuple(s[max(0, p - n) : p + 1] for n in (long, *toxicity.SHARED))

    for text, toxic in rows:
        for w in lexical.words_of(text):
            for g in grams(w):
                counts[toxic][g] += 1
    seen = set(counts[0]) | set(counts[1])
    mids, lows = defaultdict(set), defaultdict(set)
    for g, a, b in seen:
        mids[a].add(g)
        lows[b].add(a)
    letters = max(sum(x[:-1] == b[:-1] for x in lows) for b in lows)

    def continued(of, table, below):
        same = [x for x in table if x[:-1] == of[:-1]]
        return (max(len(table[of]) - d, 0) + d * len(same) * below) / sum(len(table[x]) for x in same)

    def left(c, h):
        n = [k for g, k in counts[c].items() if g[0][:-1] == h]
        return (1 - sum(max(k - d, 0) for k in n) / (sum(n) + prior), sum(n)) if n else (1.0, 0)

    def odds(word):
        total = 0.0
        for g, a, b in grams(word):
            free = [left(c, g[:-1]) for c in (0, 1)]
            if (g, a, b) not in seen:
                total += np.log(free[1][0] / free[0][0])
                continue
            shared = continued(a, mids, continued(b, lows, 1 / letters))
            p = [(max(counts[c][g, a, b] - d, 0) / (free[c][1] + prior) if free[c][1] else 0) + free[c][0] * shared for c in (0, 1)]
            total += np.log(p[1] / p[0])
        return total

    return odds


def test_toxicity_against_brute_force(labelled):
    docs, labels = labelled
    rows = toxicity._labelled(docs, labels).where("doc_id < 60").cache()
    odds = brute_kneser_ney([(r["text"], r["toxic"]) for r in rows.collect()])
    model = toxicity.train_counts(rows)
    texts = ["vilewort and hateful", "", None, "zyxomma", prose(30, 77) + " scumbags", "½ 12"]
    words = sorted({w for t in texts for w in lexical.words_of(t)})
    assert np.allclose(model.evidence(words), [odds(w) for w in words], atol=1e-5)
    want = []
    for t in texts:
        own = [odds(w) for w in lexical.words_of(t)]
        want.append(sum(np.log(1 - toxicity.MIXED + toxicity.MIXED * np.exp(e)) for e in own) / (len(own) + toxicity.STEADY))
    got = toxicity.figures(model, texts, {})
    assert np.allclose(got, want, atol=1e-6)
    scored = toxicity.score_rows(rows.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert np.allclose([r["score"] for r in scored.orderBy("doc_id").collect()], 1 / (1 + np.exp(-model.slope * (np.array(want) - model.middle))), atol=1e-5)


# 10 languages


def test_languages(spark, empty):
    tongues = {"en": ["the", "and", "house", "walking", "under"], "fr": ["le", "et", "maison", "marchant", "sous"], "de": ["das", "und", "haus", "gehend", "unter"]}
    rows = []
    for i in range(300):
        lang = list(tongues)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join(r.choice(tongues[lang]) for _ in range(r.randint(3, 30))), lang, "s", 1))
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (1002, "123 !!", "fr", "s", 1), (1003, "marchante maisonnette", None, "s", 1), (1004, "漢字", None, "s", 1), (None, "the house", "en", "s", 1)]
    got = {r["doc_id"]: r for r in langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(300))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "fr"]  # unseen words by their n-grams
    assert got[1004]["lang_pred"] in tongues and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == crc_held_out(i) for i in range(300))
    assert langid.identify_documents(empty).count() == 0


def brute_language(rows, text):
    return brute_languages(rows, [text])[0]


def brute_languages(rows, texts):
    """(language, score) of each text by plain dictionaries of words and n-grams."""
    counts = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))

    def grams(w, n):
        s = f"^{w}$" if n > 1 else w
        return [s[i : i + n] for i in range(len(s) - n + 1)]

    for lang, words in rows:
        for w in words:
            counts[0][w][lang] += 1
            for n in langid.SIZES:
                for g in grams(w, n):
                    counts[n][g][lang] += 1
    languages = sorted({lang for lang, _ in rows})
    total = {(n, lang): sum(by[lang] for by in counts[n].values()) for n in counts for lang in languages}

    def known(n, key):
        by = counts[n].get(key, {})
        return any(by.get(lang, 0) >= langid.SHARE * total[n, lang] and by.get(lang, 0) > (n == 0) for lang in languages)

    @lru_cache(maxsize=None)
    def logs(w):
        for n, keys in [(0, [w])] + [(n, grams(w, n)) for n in langid.SIZES]:
            found = [k for k in keys if known(n, k)]
            if found:
                return [np.mean([np.log((counts[n][k][lang] + 0.1) / (total[n, lang] + 1)) for k in found]) for lang in languages]
        return [0.0] * len(languages)

    def told(text):
        words = lexical.words_of(text)
        if not words:
            return "und", 0.0
        sums = np.array([logs(w) for w in words]).sum(axis=0)
        share = np.exp((sums - sums.max()) / max(1.0, np.sqrt(len(words))))
        return languages[int(sums.argmax())], 1 / share.sum()

    return [told(t) for t in texts]


def test_languages_against_brute_force(spark):
    r = random.Random(3)
    words = {lang: [w + ending for w in r.sample(VOCAB, 120)] for lang, ending in (("aa", ""), ("bb", "o"), ("cc", "n"), ("dd", "st"))}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 40))), lang, "s", 1) for i, lang in enumerate(list(words) * 40)]
    odd = ["½ ² ①", "Ⅷ ৴", "xyzzy quux", "ａｂｃ", "no½way", "12 _ --", prose(40, 8), "ß" * 600, "été ĳ"]
    rows += [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)]
    training = [(lang, lexical.words_of(t)) for i, t, lang, *_ in rows if lang and not crc_held_out(i)]
    got = {x["doc_id"]: x for x in langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        lang, score = brute_language(training, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5, t
    assert [got[1000 + i]["lang_pred"] for i in (0, 1, 5)] == ["und"] * 3


def test_languages_of_many_labels(spark, monkeypatch):
    """The share doesn't depend on how many languages there are, and the entries' bound holds."""
    rows = [(i, f"word{chr(97 + i % 26)}x common tok{chr(97 + i // 26 % 26)}", f"l{i % 300}", "s", 1) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)
    assert len(model.languages) == 300 and "common" in {w for w in ["common"] if lexical.lookup(model.tables[0].keys, lexical.Marked([w]).keys())[0] >= 0}
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 900)
    assert sum(len(t.more) for t in langid.train(df).tables.values()) <= 900


def test_languages_keep_rare_keys(spark):
    """A word that is a millionth of its language is known, and so are n-grams that were seen once."""
    ids = [i for i in range(20) if not crc_held_out(i)]
    rows = [(i, "alpha beta " * 500_000, lang, "s", 1) for i, lang in zip(ids, ("aa", "bb", "cc"), strict=False)]
    rows += [(ids[3], "zyx zyx", "bb", "s", 1), (ids[4], "quvwk", "cc", "s", 1), (105, "zyx", None, "s", 1), (109, "uvw", None, "s", 1)]
    got = {r["doc_id"]: r for r in langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[105]["lang_pred"] == "bb" and got[109]["lang_pred"] == "cc"
    assert got[105]["score"] > 0.9 and got[109]["score"] > 0.8


@pytest.mark.parametrize("entries", [0, 40, 1500])
def test_languages_are_the_same_by_joins(spark, monkeypatch, entries):
    """Where the broadcast holds few entries or none, predictions and scores still follow all keys; rows and columns are kept."""
    r = random.Random(5)
    words = {lang: [w + ending for w in r.sample(VOCAB, 60)] for lang, ending in (("aa", ""), ("bb", "o"), ("cc", "n"), ("dd", "st"))}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 30))), lang, "s", 1) for i, lang in enumerate(list(words) * 25)]
    odd = ["½ ² ①", "xyzzy quux", "no½way", None, "", "aaaaaaaa aaaaaaaa bob", prose(40, 8), "ß" * 600, "漢字 zzzz", words["bb"][0] + "q " + words["cc"][1] + "q"]
    rows += [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)] + rows[:3] + [(None, rows[5][1], "bb", "s", 1), (7, "another text", "cc", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(langid, "MODEL_ENTRIES", entries)
    model = langid.train(df)
    assert model.rest is not None and sum(len(t.more) for t in model.tables.values()) <= entries
    training = [(lang, lexical.words_of(t)) for i, t, lang, *_ in rows if lang and not crc_held_out(i)]
    want = {t: brute_language(training, t) for _, t, *_ in rows}
    got = langid.identify(df, model, ["text", "source"]).collect()
    assert sorted(map(str, (x["doc_id"] for x in got))) == sorted(str(x[0]) for x in rows) and {x["source"] for x in got} == {"s"}
    for x in got:
        lang, score = want[x["text"]]
        assert x["lang_pred"] == lang and abs(x["score"] - score) < 1e-5, x["text"]
    told = {(x["doc_id"], x["text"]) for x in got if x["lang_pred"] != "und" and x["score"] >= 0.5}
    assert {(x["doc_id"], x["text"]) for x in langid.drop_unidentified(df).collect()} == told
    assert langid.identify(df.where("false"), model).count() == 0


def test_languages_untrained(spark):
    df = spark.createDataFrame([(1, "the house", None, "s", 1)], SCHEMA)
    assert [tuple(r) for r in langid.identify_documents(df).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_drop_unidentified_keeps_columns(docs):
    out = langid.drop_unidentified(docs)
    assert out.columns == docs.columns
    assert not {4, 5, 9} & {r["doc_id"] for r in out.select("doc_id").collect()}
