"""Normalised words of a text as 32-bit hashes, and numpy work on them.

Text is normalised and hashed by Spark's own expressions; Python gets flat
Arrow arrays of integers, never strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case; tags, TeX commands, entities, punctuation and layout become
    single blanks. Null stays null."""
    c = F.lower(text)
    c = F.regexp_replace(c, r"</?[a-z][^<>]*>|\\[a-z]+|&[a-z0-9#]+;", " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def word_hashes(norm: Column) -> Column:
    """One int per word of a normalised text; an empty array for an empty one."""
    return F.when(norm == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(norm, " "), lambda w: F.hash(w)))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` successive words of a flat array, across borders too."""
    w = words.astype(np.int64).astype(np.uint64)
    n = max(0, len(w) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += w[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def gram_rows(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, offsets) per text. A text shorter than ``k`` words has one gram,
    all of it; an empty one has none."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words.astype(np.int32), np.zeros(k, np.int32)])
    all_grams = grams(padded, k)
    at = np.repeat(offsets[:-1], counts) + np.arange(starts[-1]) - np.repeat(starts[:-1], counts)
    out = all_grams[at]
    for i in np.flatnonzero((n > 0) & (n < k)):  # not into the next text
        own = np.zeros(k, np.int32)
        own[: n[i]] = words[offsets[i] : offsets[i + 1]]
        out[starts[i]] = grams(own, k)[0]
    return out, starts
