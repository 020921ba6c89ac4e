"""Hashes whose 64-bit arithmetic wraps around, which ANSI SQL forbids: Arrow-batched functions over numpy integers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 64-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_ALL = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & _ALL
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and below 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@F.pandas_udf(T.StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")


@F.pandas_udf(T.IntegerType())
def hnsw_level(text: pd.Series) -> pd.Series:
    """Level of an id in a layered graph: floor(-ln U) of its hash, 32 at most."""
    h = np.array([fnv1a((t or "").encode()) for t in text], np.uint64)
    return pd.Series(np.minimum(np.floor(-np.log(_unit(_mix(h)))), 32).astype(np.int32))


@F.pandas_udf(T.StringType())
def vector_fingerprint(vector: pd.Series) -> pd.Series:
    """First 12 bytes of the SHA-256 of a vector's little-endian floats, in hexadecimal."""
    return vector.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest()[:24])


def rendezvous(shards: Sequence[str], weights: Sequence[float]):
    """A column function key -> shard: the largest weight / -ln(U(hash(key, shard))). A new shard only takes keys to itself."""

    @F.pandas_udf(T.StringType())
    def pick(key: pd.Series) -> pd.Series:
        h = np.array([[fnv1a(f"{k}\x00{s}".encode()) for s in shards] for k in key], np.uint64).reshape(len(key), len(shards))
        score = np.asarray(weights) / -np.log(_unit(_mix(h)))
        return pd.Series(np.array(shards, object)[score.argmax(1)] if len(key) else [], dtype=object)

    return pick
