"""Filters over 64-bit keys, sized by the number of keys: a later scan passes over most of what nobody asked for.

A filter lets some other keys pass; the exact match is a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, LEAST, MOST = 16, 16, 30  # log2 of the least and of the most bits: 8 kB to 128 MB


def key_filter(keys: DataFrame, code: Column) -> np.ndarray | None:
    """Bitmap of the low bits of ``code`` over the rows of ``keys``, as 64-bit words; None without rows.

    Words are or-ed together by Spark and come as one Arrow table.
    """
    n = keys.count()
    if not n:
        return None
    bits = min(MOST, max(LEAST, (n * BITS_A_KEY - 1).bit_length()))
    low = code.bitwiseAND(F.lit((1 << bits) - 1))
    words = (keys.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the filter lets pass."""
    low = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
