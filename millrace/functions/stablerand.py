"""Draws that are functions of a row's key and a salt, the same in any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(salt: str, *parts: Column) -> Column:
    """md5 of salt and parts joined by colons: an order as good as a shuffle."""
    return F.md5(F.concat_ws(":", F.lit(salt), *(p.cast("string") for p in parts)))


def pick(n: int | Column, salt: str, *parts: Column) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(key(salt, *parts), 1, 8), 16, 10).cast("long"), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"))


def shuffled(c: Column, salt: str, *parts: Column) -> Column:
    """The array in the order of its elements' keys."""
    tagged = F.transform(c, lambda x: F.struct(key(salt, *parts, x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(tagged), lambda r: r["v"])


def sample(c: Column, k: int, salt: str, *parts: Column) -> Column:
    """``k`` distinct places of the array, in the order drawn."""
    return F.slice(shuffled(c, salt, *parts), 1, k)
