"""Words and character n-grams as 64-bit keys, for the statistical models of this subpackage.

A word is a run of letters (Unicode category L), in lower case, between the marks ^ and $; runs of more than
LONGEST letters are cut into words of that length. Words whose 64-bit keys agree count as one. The key of an n-gram is a sum of its
characters' codes times odd constants that depend on the distance to its last character, so the keys of all
n-grams of many words come from a few array additions, and the key of a history is part of the sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 256  # longer runs of letters are cut into pieces of this length, so that no array depends on one word
SLICE_LETTERS = 250_000  # laid out at once: arrays over them take about 160 bytes a letter
_rng = np.random.default_rng(20240101)
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    if not "".join(found).isalpha():  # numbers that aren't decimal digits, such as a half, are no letters
        found = [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Marked:
    """Distinct words laid out as one array of character codes, each between its marks."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le") if words else b"", np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(self.codes)) - np.repeat(self.starts, size)

    def sums(self, longest: int) -> list[np.ndarray]:
        """For n = 1 .. longest the unmixed key of the n characters that end at each place (fewer near the start)."""
        out, total = [], np.zeros(len(self.codes), np.uint64)
        for j in range(longest):
            shifted = np.zeros_like(total)
            if j < len(total):
                shifted[j:] = self.codes[: len(total) - j] * _FACTORS[j]
            shifted[self.place < j] = 0
            total = total + shifted
            out.append(total)
        return out

    def first(self) -> np.ndarray:
        """The factor term of each place's own character: what a history's key lacks of its n-gram's."""
        return self.codes * _FACTORS[0]

    def keys(self) -> np.ndarray:
        """A key for each whole word."""
        size = np.diff(np.append(self.starts, len(self.codes)))
        far = np.minimum(self.place, 63)
        weight = _FACTORS[far] * (self.place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return _mix(np.add.reduceat(self.codes * weight, self.starts) + size.astype(np.uint64)) if len(self.starts) else np.zeros(0, np.uint64)


def slices(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The words in parts of at most SLICE_LETTERS letters and marks, or one word; each with the number of its first."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_LETTERS, "right")))
        yield at, words[at:to]
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    return _mix(x)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def id_share(doc_id: Column, salt: str, parts: int) -> Column:
    """A fixed number below ``parts`` for each id."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), F.lit(parts))
