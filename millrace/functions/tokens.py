"""Texts cut to a number of a model's tokens."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SAFE = re.compile(r"(?<=\S)(?=\s)")
CHARACTERS = 8


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def first_tokens(tokenizer, text: str, n: int) -> str:
    """decode(encode(text)[:n]) for a byte-level tokenizer, without encoding all of a long text.

    A piece that ends before a blank that follows a non-blank encodes alike whatever comes after it, as no token of such
    tokenizers spans that place. So the text is encoded up to such places, ever further, until there are n tokens.
    """
    size = CHARACTERS * (n + 1)
    while True:
        piece = text
        if size < len(text):
            found = SAFE.search(text, size)
            piece = text[: found.start()] if found else text
        ids = tokenizer.encode(piece, add_special_tokens=False).ids
        if len(ids) >= n or len(piece) == len(text):
            return tokenizer.decode(ids[:n], skip_special_tokens=False)
        size *= 2


def first_model_tokens(text: Column, n: int, path: str) -> Column:
    """The text of the first ``n`` tokens by the tokenizer file ``path``, which every executor can read; null for null."""

    @pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else first_tokens(_tokenizer(path), t, n) for t in texts], dtype=object)

    return cut(text)
