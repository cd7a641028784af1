"""Perceptual hashes of product images.

Images are decoded by Spark's image source in the JVM (JPEG, PNG, GIF, BMP); what it cannot read
has a null hash. Only the hash is made here, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8


def phash(grey: np.ndarray) -> int:
    """64 bits: which of the low frequencies of the image are above their median."""
    rows = np.linspace(0, grey.shape[0], SIDE + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], SIDE + 1).astype(int)
    small = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
    k = np.arange(SIDE)
    basis = np.cos(np.pi * (k[None, :] + 0.5) * k[:LOW, None] / SIDE)
    f = (basis @ small @ basis.T).ravel()
    bits = f > np.median(f[1:])
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64))


@F.pandas_udf(T.LongType())
def image_hash(image: pd.DataFrame) -> pd.Series:
    """Of the image source's columns height, width, nChannels and data (bytes by row)."""

    def one(height, width, channels, data):
        if data is None or min(height, width, channels) < 1:
            return None
        x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        return phash(x[:, :, : min(channels, 3)].mean(2))

    return pd.Series([one(*row) for row in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True)], dtype="Int64")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of the image files below ``path``."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("image.origin").alias("path"), image_hash("image").alias("hash"))
