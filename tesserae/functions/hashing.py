"""MurmurHash3 x64 128, the digest of samples, as an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# fixed values
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & MASK


def _fmix(k: int) -> int:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = ((k ^ k >> 33) * m) & MASK
    return k ^ k >> 33


def murmur3_128(data: bytes, seed: int = 0) -> bytes:
    """16 bytes, little-endian halves."""
    h1 = h2 = seed
    n = len(data) // 16
    for k1, k2 in np.frombuffer(data[: 16 * n], "<u8").reshape(n, 2).tolist():
        h1 ^= _rotl(k1 * C1 & MASK, 31) * C2 & MASK
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & MASK
        h2 ^= _rotl(k2 * C2 & MASK, 33) * C1 & MASK
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & MASK
    tail = data[16 * n :]
    if len(tail) > 8:
        h2 ^= _rotl(int.from_bytes(tail[8:], "little") * C2 & MASK, 33) * C1 & MASK
    if tail:
        h1 ^= _rotl(int.from_bytes(tail[:8], "little") * C1 & MASK, 31) * C2 & MASK
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK
    h2 = (h2 + h1) & MASK
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & MASK
    return h1.to_bytes(8, "little") + ((h2 + h1) & MASK).to_bytes(8, "little")


def sample_digest(data: Column, seed: int = 0) -> Column:
    """Digest of a binary column; null for null."""

    @F.pandas_udf("binary")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else murmur3_128(bytes(v), seed))

    return digest(data)
