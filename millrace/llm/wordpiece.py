"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building pieces.

The vocabulary is compiled into a byte trie with failure links. A node that can't go on fails to the node
of the longest suffix that a following piece can begin with, and carries how many pieces are popped on the
way, so a word of n bytes takes at most 2n moves. Pieces that start a word and pieces that continue one are
told apart by a root each. Distinct words run once a batch; the memo is bounded.

A word is a run of bytes other than blank and 0x09-0x0D. With a byte-level vocabulary its pieces are matched
greedily: the first among the pieces that begin with a blank, the others among the rest, each the longest
that fits. Every single byte is a piece, so every word can be cut; if a vocabulary lacks one, the whole
word counts as one unknown piece.

Defined results: a null or empty text has no words and no tokens; texts and words of any length are counted
whole, byte by byte; repeated rows and null ids are kept; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ready, tidy
from millrace.llm.packing import byte_alphabet

MEMO_WORDS = 200_000


class LongestMatch:
    """``starts``: pieces that can begin a word; ``inner``: pieces that can go on with one."""

    def __init__(self, starts: list[bytes], inner: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, starts), (1, inner)):
            for p in pieces:
                node = root
                for b in p:
                    if b not in self.next[node]:
                        self.next[node][b] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = self.next[node][b]
                piece[node] = bool(p) or piece[node]
        n = len(self.next)
        self.fail: list[int] = [-1] * n  # -1: no cut exists
        self.pops = [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, child in self.next[node].items():
                if piece[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.pops[node]
                    while at >= 0 and b not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][b], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy cut; 1 if there is none."""
        node, total = 0, 0
        move, fail, pops = self.next, self.fail, self.pops
        for b in word:
            while b not in move[node]:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = move[node][b]
        while node != 1:
            if node == 0:
                return 0
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """From a byte-level vocabulary: pieces that begin with a blank start words (the blank left out), the others go on with them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return LongestMatch([p[1:] for p in pieces if p[:1] == b" " and len(p) > 1] + [bytes([b]) for b in range(256)], [p for p in pieces if b" " not in p])


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, longest_word) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(vocabulary_path).count
        memo: dict[bytes, int] = {}
        for batch in batches:
            words_, tokens, longest = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                total = 0
                for word, n in Counter(words).items():
                    if (k := memo.get(word)) is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        k = match(word)
                        if len(word) <= 256:
                            memo[word] = k
                    total += n * k
                words_.append(len(words))
                tokens.append(total)
                longest.append(max(map(len, words), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words_, tokens, longest))], ["doc_id", "n_words", "n_tokens", "longest_word"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_tokens long, longest_word long")
