"""64-bit feature hashes and probe positions, in Arrow batches (the additions wrap, which ANSI SQL forbids)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 0x9E3779B97F4A7C15  # fixed value: distance between a feature's probes
BAND_FACTOR = 0xBF58476D1CE4E5B9  # fixed value: multiplier of the band hash


def hash_features(features: list[bytes], seed: int = 0) -> np.ndarray:
    """One-at-a-time style hash of byte strings, modulo 2^64; all strings advance together, one byte per round."""
    lens = np.array([len(f) for f in features], np.int64)
    h = np.full(len(features), seed, np.uint64)
    if len(features):
        width = int(lens.max())
        grid = np.zeros((len(features), width), np.uint8)
        for i, f in enumerate(features):
            grid[i, : len(f)] = np.frombuffer(f, np.uint8)
        for c in range(width):
            on = lens > c
            x = (h[on] + grid[on, c].astype(np.uint64)) * np.uint64(1025)
            h[on] = x ^ (x >> np.uint64(6))
        h = h * np.uint64(9)
        h = h ^ (h >> np.uint64(11))
        h = h * np.uint64(32769)
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _bytes(s: pd.Series) -> list[bytes]:
    return [(x or "").encode() for x in s]


def probe(h: np.ndarray, n: np.ndarray, base: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    most = int(n.max()) if len(n) else 0
    steps = np.arange(most, dtype=np.uint64) * np.uint64(STEP)
    pos = ((h[:, None] + steps[None, :]) % size.astype(np.uint64)[:, None]).astype(np.int64) + base[:, None]
    return [p[:k] for p, k in zip(pos.astype(np.int32), n)]


@F.pandas_udf(T.LongType())
def hash_feature(feature: pd.Series) -> pd.Series:
    return pd.Series(hash_features(_bytes(feature)).view(np.int64))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def probe_positions(feature: pd.Series, n: pd.Series, base: pd.Series, size: pd.Series) -> pd.Series:
    """Positions of a feature's `n` probes within [base, base + size)."""
    return pd.Series(probe(hash_features(_bytes(feature)), n.to_numpy(np.int64), base.to_numpy(np.int64), size.to_numpy(np.int64)))


def band_values(n: int, row: np.ndarray, bit: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of the bands of `n` fingerprints, given as the row and the position of every bit."""
    seg = np.zeros((n, 160), np.uint64)
    np.bitwise_or.at(seg, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(STEP), (n, bands))
    for i in range(rows):
        h = (h ^ seg[:, (np.arange(bands) * rows + i) % 160]) * np.uint64(BAND_FACTOR)
    return h


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_hashes(bits: pd.Series, bands: pd.Series, rows: pd.Series) -> pd.Series:
    """One hash per band of `rows` 64-bit segments; a band without bits hashes to a value of its own, too."""
    b, r = (int(bands.iloc[0]), int(rows.iloc[0])) if len(bits) else (1, 1)
    lens = np.array([0 if x is None else len(x) for x in bits], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *[x for x in bits if x is not None]]).astype(np.int64)
    return pd.Series(list(band_values(len(bits), np.repeat(np.arange(len(bits)), lens), flat, b, r).view(np.int64)))
