"""A bitmap of bounded size that leaves most unwanted rows out before an exact join shuffles them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 1 << 26


def key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) of a column of 64-bit keys; where it fills up with more keys, it only leaves out less."""
    place = F.pmod(keys[keys.columns[0]], F.lit(_BITS)) + 1  # counted from 1; a bucket holds 32768
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((_BITS // 32768, 4096), np.uint8)
    for row in rows:
        bits[row["n"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.astype(np.int64) % _BITS
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
