"""Sets of hashed values that all tasks know, as bit arrays of bounded size.

They may say yes too often, never no: what they let through is joined exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a set of one size; 4 MB whatever the data.
BITS = 1 << 25
#: Fewest and most bits of a set that fits its values; 16 MB at most.
FEWEST, MOST = 1 << 18, 1 << 27


def bit_array(values: DataFrame, bit: Column, bits: int = BITS) -> np.ndarray:
    """The bits, numbers below ``bits``, of all rows."""
    bit = bit.alias("bit")
    words = values.select(bit).select(
        (F.col("bit") / 32).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1), (F.col("bit") % 32).cast("int")).alias("mask"),
    )
    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bits / 32 rows at most
    table = np.zeros(bits // 32, np.int32)
    table[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return table


def is_set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 5].view(np.uint32) >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1


def fitting(hashes: DataFrame, column: str) -> np.ndarray:
    """A set of values that are hashes themselves, of 16 bits a value while ``MOST`` allows it."""
    bits = max(FEWEST, min(MOST, 1 << (16 * hashes.count()).bit_length()))
    return bit_array(hashes, F.col(column).bitwiseAND(F.lit(bits - 1)), bits)


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in a set that ``fitting`` made."""
    return is_set(table, (hashes & np.uint64(32 * len(table) - 1)).astype(np.int64))
