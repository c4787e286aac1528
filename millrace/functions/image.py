"""Functions of images, given as arrays of grey values and a width or as decoded pixels, as pandas UDFs on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def shrink(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Box mean to rows x columns."""
    for axis, n in ((0, rows), (1, columns)):
        sums = np.concatenate([np.zeros_like(image.take([0], axis)), np.cumsum(image, axis=axis)], axis=axis)
        cuts = np.linspace(0, image.shape[axis], n + 1)
        low = np.minimum(cuts.astype(int), image.shape[axis] - 1)
        part = np.expand_dims(cuts - low, 1 - axis)
        edge = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
        image = np.diff(edge, axis=axis) * (n / image.shape[axis])
    return image


def frequencies(image: np.ndarray, keep: int = 8) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(len(image))[None]
    cos = np.cos(np.pi * k * (2 * x + 1) / (2 * len(image)))
    return cos @ image @ cos.T


def _grey(pixels, width) -> np.ndarray | None:
    if pixels is None or width is None or width <= 0 or len(pixels) < width:
        return None
    rows = len(pixels) // int(width)
    return np.asarray(pixels[: rows * int(width)], float).reshape(rows, int(width))


@pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the 32 x 32 image exceed their median; null without a whole row."""

    def one(p, w):
        image = _grey(p, w)
        if image is None:
            return None
        return hash_of(image)

    return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)], dtype=object)


@pandas_udf(T.BooleanType())
def similar(a: pd.Series, a_width: pd.Series, b: pd.Series, b_width: pd.Series) -> pd.Series:
    """Whether two images, shrunk to 64 x 64, differ by no more than 5 anywhere; null if either is missing."""

    def one(p, pw, q, qw):
        x, y = _grey(p, pw), _grey(q, qw)
        return None if x is None or y is None else bool((np.abs(shrink(x, 64, 64) - shrink(y, 64, 64)) <= 5).all())

    return pd.Series([one(*r) for r in zip(a, a_width, b, b_width, strict=True)], dtype=object)


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey values of decoded pixels, blue first as Spark's image source has them, with the usual weights of the eye."""
    pixels = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels).astype(float)
    return pixels[..., 0] if channels == 1 else np.floor((pixels[..., 2] * 299 + pixels[..., 1] * 587 + pixels[..., 0] * 114) / 1000)


def tone(image: np.ndarray, threshold: float, low: int = 50, high: int = 205) -> str:
    """black or white if that share of the values is dark or bright, else normal."""
    return "black" if (image <= low).mean() >= threshold else "white" if (image >= high).mean() >= threshold else "normal"


def hash_of(image: np.ndarray) -> str:
    f = frequencies(shrink(image, 32, 32)).round(6).ravel()
    return np.packbits(f > np.median(f)).tobytes().hex()


def examined(images: DataFrame, threshold: float = 0.992) -> DataFrame:
    """Rows (path, width, height, colour, image_hash) of decoded images (``sources.io.read_pictures``); all but the path are null where a file can't be decoded."""

    @pandas_udf("width int, height int, colour string, image_hash string")
    def look(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        found = []
        for h, w, c, d in zip(height, width, channels, data, strict=True):
            if not d or h <= 0 or w <= 0:
                found.append((None, None, None, None))
                continue
            image = grey(d, h, w, c)
            found.append((w, h, tone(image, threshold), hash_of(image)))
        return pd.DataFrame(found, columns=["width", "height", "colour", "image_hash"]).astype({"width": "Int32", "height": "Int32"})

    return images.select("path", look("height", "width", "channels", "data").alias("seen")).select("path", "seen.*")
