"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words are runs of non-blank characters of the normalised text; BPE never merges across them. The most
frequent words of the corpus (those that make up at least SHARE of all words, counted over all documents, so
at most 1 / SHARE of them) are encoded once and compiled on the driver into a minimal acyclic automaton:
equal suffixes share states, and each arc carries how many words of the lexicon it skips, so that the sum
over a word's path is its place in the list of id outputs. The image, bounded by the lexicon's parameters, is
broadcast; every Python worker writes it to an unnamed temporary file and maps that into memory. Batches of
distinct words run through the automaton together. Words that it doesn't hold are merged exactly: all words
of a batch side by side, each step joining in every word its first pair of the lowest rank.

Texts are composed by the library's own normaliser, as Python's tables of combining classes are of another Unicode
version. Texts with the vocabulary's special tokens, with the separators U+001C to U+001F, or with a character that
the library and Python split or lower differently are encoded whole by the vocabulary's own pipeline. Both work
character by character, so each worker finds these by trying every character that it meets, once, between letters.

Defined results: a null or empty text has no ids and the digests of the empty string; texts of any length are
coded whole, those with words of more than LONGEST_WORD characters by the vocabulary's pipeline; equal texts get equal
rows; repeated rows and null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ready, scratch, tidy
from millrace.llm.packing import byte_alphabet

SHARE = 2e-6
WORD_BYTES = 48
MEMO_WORDS = 200_000
FLUSH_WORDS = 400_000
NEVER = 2**31 - 1
LONGEST_WORD = 1000  # merging side by side takes a step for each merge of the longest word
_ODD = re.compile("[\x1c-\x1f]")
#: All but some blocks of letters and signs that composition leaves alone as long as only they meet.
_COMPOSES = re.compile("[^\0-\u02ff\u0388-\u0482\u048a-\u0590\u05d0-\u05ea\u0621-\u064a\u0904-\u0939\u2002-\u2069\u3000-\u3029\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff60]")


def build_image(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``entries`` as bytes: header, arc keys (state * 256 + byte, sorted), targets, skips, final flags, id offsets, ids."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[tuple[tuple[int, int], ...], bool]] = []
    path: list[list] = [[{}, False]]  # the last word's states that may still change

    def close(down_to: int, word: bytes) -> None:
        while len(path) > down_to + 1:
            arcs, final = path.pop()
            shape = (tuple(arcs.items()), final)
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
            path[-1][0][word[len(path) - 1]] = register[shape]

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same, last)
        path.extend([{}, False] for _ in w[same:])
        path[-1][1] = True
        last = w
    close(0, last)
    states.append((tuple(path[0][0].items()), path[0][1]))
    root = len(states) - 1
    held = np.zeros(len(states), np.int64)  # words below; children come before their parents
    keys, targets, skips = [], [], []
    for s, (arcs, final) in enumerate(states):
        seen = int(final)
        for byte, to in arcs:
            keys.append(s * 256 + byte)
            targets.append(to)
            skips.append(seen)
            seen += int(held[to])
        held[s] = seen
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    arrays = [np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(skips, np.int64)[order], np.array([f for _, f in states], np.int64), offsets, flat]
    head = np.array([root, *map(len, arrays)], np.int64)
    return b"".join(a.astype("<i8").tobytes() for a in [head, *arrays])


class Transducer:
    """A memory-mapped image."""

    def __init__(self, image: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(image)
        self.file.flush()
        data = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), "<i8")
        self.root, sizes, at, parts = int(data[0]), data[1:7], 7, []
        for n in sizes.tolist():
            parts.append(data[at : at + n])
            at += n
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, or -1; all words step together."""
        n = len(words)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return place
        size = np.fromiter(map(len, words), np.int64, n)
        live = np.flatnonzero((size <= WORD_BYTES) & (size > 0))
        start = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(words), np.uint8)
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(live):
            key = state[live] * 256 + data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[arc] == key
            live, arc = live[good], arc[good]
            state[live] = self.targets[arc]
            total[live] += self.skips[arc]
            step += 1
            done = size[live] == step
            ended = live[done]
            hit = ended[self.final[state[ended]] == 1]
            place[hit] = total[hit]
            live = live[~done]
        return place

    def outputs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at these places in order, number in ``places`` of each id)"""
        size = self.offsets[places + 1] - self.offsets[places]
        owner = np.repeat(np.arange(len(places)), size)
        first = np.cumsum(size) - size
        return self.ids[np.arange(size.sum()) - first[owner] + self.offsets[places][owner]], owner


class Merger:
    """Exact byte-pair merges of many words at once."""

    def __init__(self, spec: dict):
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in letters.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[x + y] for x, y in pairs], np.int64)
        symbols = np.concatenate([self.inner, self.last])
        self.first = self.rank(symbols[:, None], symbols[None, :])  # of two bytes, those from 256 on ending a word
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile("\n|" + split["pattern"]["Regex"])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, piece of each id)"""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, piece = self.inner[data], np.repeat(np.arange(len(pieces)), size)
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        symbol = data.astype(np.int64)
        symbol[ends] += 256
        rank = np.full(len(ids), NEVER, np.int64)
        rank[:-1] = np.where(piece[1:] == piece[:-1], self.first[symbol[:-1], symbol[1:]], NEVER)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            new = np.concatenate([[True], piece[1:] != piece[:-1]])
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            live = least < NEVER
            if 4 * live.sum() < 3 * len(ids):
                done.append((ids[~live], piece[~live]))
                ids, piece, rank, least = ids[live], piece[live], rank[live], least[live]
                if not len(ids):
                    break
            at = np.flatnonzero((rank == least) & (least < NEVER))
            at = at[np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])]
            ids[at] = self.joined[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # each earlier pair has lost one place
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            rank[at] = NEVER
            right = at[at + 1 < len(ids)]
            right = right[piece[right] == piece[right + 1]]
            rank[right] = self.rank(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[piece[left] == piece[left + 1]]
            rank[left] = self.rank(ids[left], ids[left + 1])
        if not done:
            return ids, piece
        ids, piece = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of normalised text in order, word of each id)"""
        pieces, owner, at = [], [], 0
        for p in self.pieces.findall("\n".join(words)):
            if p == "\n":
                at += 1
            else:
                pieces.append(p.encode())
                owner.append(at)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, piece = self.merge(pieces)
        return ids, np.array(owner, np.int64)[piece]

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        ids, owner = self.encode(words)
        edges = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        return [flat[s:e] for s, e in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """(whole pipeline, exact merges, token of each id, special tokens)"""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    tokens = {i: t for t, i in whole.get_vocab(with_added_tokens=True).items()}
    return whole, Merger(spec), tokens, special


@lru_cache(maxsize=1)
def _composer():
    from tokenizers.normalizers import NFC

    return NFC()


def split_words(text: str) -> list[str]:
    """The words of the normalised text: composed, lower case letter by letter (without the special final sigma)."""
    if not text.isascii():
        if _COMPOSES.search(text):  # by the library, whose classes of marks aren't those of Python's tables
            text = _composer().normalize_str(text)
        text = text.replace("Σ", "σ")
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all whole texts, counted in the workers before the shuffle; the row without a word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([None, *seen.keys()], pa.string()), pa.array([seen.total(), *seen.values()], pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(split_words(text.as_py()))
                if len(seen) > FLUSH_WORDS:
                    yield out()
        if seen:
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_image(docs: DataFrame, tokenizer_path: str, share: float = SHARE) -> bytes:
    """The transducer of the corpus's frequent words: at most 1 / share of them, of at most WORD_BYTES bytes, reach the driver."""
    with scratch():
        counts = cut(count_words(docs).where("word IS NULL OR n > 1"), "words")
        total = counts.where("word IS NULL").first()
        frequent = counts.where(F.col("word").isNotNull() & (F.octet_length("word") <= WORD_BYTES) & (F.col("n") >= share * (total["n"] if total else 0)))
        listed = [w for w in frequent.select("word").toArrow().column(0).to_pylist() if not _ODD.search(w)]
    return build_image({w.encode(): ids for w, ids in zip(listed, vocabulary(tokenizer_path)[1].words(listed), strict=True)})


class Coder:
    """Encodes and decodes whole texts with a transducer and, behind it, exact merges."""

    def __init__(self, image: bytes, tokenizer_path: str):
        self.lexicon = Transducer(image)
        self.whole, self.merge, self.tokens, special = vocabulary(tokenizer_path)
        self.odd = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, special)]))
        most = max(self.tokens)
        # names by id; the last, which -1 finds, parts words
        self.numbers = [*map(str, range(most + 1)), "\n"]
        self.names = [*(self.tokens.get(i, "") for i in range(most + 1)), "\n"]
        self.ids: dict[str, str] = {}
        self.out: dict[str, str] = {}
        self.tried: set[str] = set()
        self.strange: set[str] = set()

    def is_plain(self, text: str) -> bool:
        """Whether words and merges give the ids that the whole pipeline gives."""
        if self.odd.search(text):
            return False
        if text.isascii():
            return True
        seen = set(text)
        if not seen <= self.tried:
            self._try(seen - self.tried)
        return seen.isdisjoint(self.strange)

    def _try(self, characters: set[str]) -> None:
        self.tried |= characters
        texts = [f"a{c}b" for c in characters]
        split = [split_words(t) for t in texts]
        each = iter(self.merge.words([w for words in split for w in words]))
        for c, text, words in zip(characters, texts, split, strict=True):
            own = [i for _ in words for i in next(each)]
            if own != self.whole.encode(text, add_special_tokens=False).ids:
                self.strange.add(c)

    def learn(self, words: set[str]) -> None:
        listed = list(words)
        places = self.lexicon.places([w.encode() for w in listed])
        known = np.flatnonzero(places >= 0)
        self._keep([listed[i] for i in known.tolist()], *self.lexicon.outputs(places[known]))
        unseen = [listed[i] for i in np.flatnonzero(places < 0).tolist()]
        self._keep(unseen, *self.merge.encode(unseen))

    def _keep(self, words: list[str], ids: np.ndarray, owner: np.ndarray) -> None:
        """Every word has an id at least, so the marks between words never meet."""
        if not words:
            return
        marked = np.insert(ids, np.searchsorted(owner, np.arange(1, len(words))), -1).tolist()
        for memo, names in ((self.ids, self.numbers), (self.out, self.names)):
            memo.update(zip(words, " ".join(map(names.__getitem__, marked)).split(" \n "), strict=True))

    def run(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(decimal ids, decoded text) of each text, both joined by single blanks as the vocabulary, which has no decoder, does."""
        split = [split_words(t) if self.is_plain(t) else None for t in texts]
        split = [words if words and max(map(len, words)) <= LONGEST_WORD else words and None for words in split]
        at = 0
        while at < len(texts):  # as many texts as the memo holds words of
            need: set[str] = set()
            to = at
            while to < len(texts) and (to == at or len(need) < MEMO_WORDS // 4):
                need.update(split[to] or ())
                to += 1
            if len(self.ids) + len(need) > MEMO_WORDS:
                self.ids.clear()
                self.out.clear()
            self.learn(need - self.ids.keys())
            for text, words in zip(texts[at:to], split[at:to], strict=True):
                if words is None:
                    ids = self.whole.encode(text, add_special_tokens=False).ids
                    yield " ".join(map(str, ids)), self.whole.decode(ids, skip_special_tokens=False)
                else:
                    yield " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.out.__getitem__, words))
            at = to


def code_documents(docs: DataFrame, tokenizer_path: str, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    spark = docs.sparkSession
    ready(spark)
    image = spark.sparkContext.broadcast(lexicon_image(docs, tokenizer_path, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(image.value, tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n, ids_sha, out_sha = [], [], []
                for ids, text in coder.run([t or "" for t in batch.column(1).to_pylist()]):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    out_sha.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
