"""Bit-exact hashes for interchange: FNV-1a 64, DJB2 and CRC-32 over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by_bytes(text: pd.Series, start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """The hash of every text of a batch: all texts take their next byte at once."""
    raw = [b"" if s is None else s.encode() for s in text]
    sizes = np.array([len(r) for r in raw], np.int64)
    data, offsets = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(sizes) - sizes
    h = np.full(len(raw), start, np.uint64)
    for i in range(int(sizes.max(initial=0))):
        alive = np.flatnonzero(sizes > i)
        h[alive] = step(h[alive], data[offsets[alive] + i])
    return pd.Series([None if s is None else Decimal(int(x)) for s, x in zip(text, h, strict=True)])


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, unsigned."""
    return _by_bytes(text, 0xCBF29CE484222325, lambda h, b: (h ^ b) * np.uint64(0x100000001B3))


@F.pandas_udf(T.DecimalType(20, 0))
def djb2(text: pd.Series) -> pd.Series:
    """h = 33 h + byte from 5381, 64 bits, unsigned."""
    return _by_bytes(text, 5381, lambda h, b: h * np.uint64(33) + b)


def crc(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
