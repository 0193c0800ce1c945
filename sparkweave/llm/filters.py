"""Bit filters: they let through every hash of a table, and of other hashes a few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import discard, materialise

#: Bits of a filter, a power of two: a filter has eight or more for each hash, and goes to every task in one megabyte to sixteen.
BITS, MOST_BITS = 1 << 23, 1 << 27


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of all values of ``hashes(term)``; beyond ``MOST_BITS / 8`` of them it still holds all, and lets more others through."""
    hashes = materialise(hashes.distinct(), "hashes")
    bits = min(max(BITS, 1 << (8 * hashes.count()).bit_length()), MOST_BITS)
    cells = hashes.select((F.pmod("term", F.lit(bits)) / 32).cast("int").alias("cell"), F.pmod("term", F.lit(32)).cast("int").alias("bit"))
    # pmod of the signed hash equals the unsigned remainder, the size being a power of two.
    got = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    discard(hashes.sparkSession, hashes)
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[got["cell"]] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
