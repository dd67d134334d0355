"""MinHash banding of short texts, and its collision curve."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Multipliers and shifts of the hash functions come from this seed, on every executor.
SEED = 20260101


def collision(similarity: float, rows: int, bands: int) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` hashes with which pairs of this similarity meet with ``recall``."""
    bands = 1
    while collision(similarity, rows, bands) < recall:
        bands += 1
    return bands


def padded_grams(text: str, q: int) -> set[str]:
    """The q-grams of a text with q - 1 marks before and after it; of an empty text, those of the marks."""
    padded = "^" * (q - 1) + text + "$" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


class MinHash:
    """``bands`` keys of ``rows`` minima each."""

    def __init__(self, rows: int, bands: int) -> None:
        random = np.random.default_rng(SEED)
        self.rows, self.bands = rows, bands
        self.times = random.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = random.integers(0, 2**63, rows * bands, dtype=np.uint64)

    def keys(self, grams: set[str]) -> np.ndarray:
        """One signed 64-bit key a band."""
        base = np.array([crc32(g.encode()) for g in grams], dtype=np.uint64)
        mixed = base[:, None] * self.times + self.plus
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        low = mixed.min(axis=0).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            key = (key ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


def with_bands(df: DataFrame, text: str, q: int, rows: int, bands: int) -> DataFrame:
    """The rows of ``df`` once for each band, with the key in ``band``.

    Partitions are evened out first: a small table can lie in a single one.
    """
    kept = df.columns

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(rows, bands)
        for b in batches:
            for part in (b.iloc[i : i + 2000] for i in range(0, len(b), 2000)):
                keys = [hashes.keys(padded_grams(t, q)) for t in part[text]]
                out = part.loc[part.index.repeat(bands)].reset_index(drop=True)
                out["band"] = np.concatenate(keys)
                yield out

    even = df.repartition(df.sparkSession.sparkContext.defaultParallelism, text)
    return even.mapInPandas(emit, f"{', '.join(f'{c} {t}' for c, t in df.select(*kept).dtypes)}, band long")
