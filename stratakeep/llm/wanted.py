"""Rows of a large table that a set of ids asks for, without a shuffle of the rest.

A bitmap of the wanted ids' slots goes to all tasks. Its size is bounded whatever the number of
ids; rows that it lets through by chance go at the exact join that follows.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 27 bits are 16 MB, the most that is ever sent; they keep 94 of 100 unwanted rows out at 8 million ids.
MOST_BITS, LEAST_BITS = 27, 18


def bits_for(n: int) -> int:
    """Base-two logarithm of a bitmap's size for n ids: 16 bits for each, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


def bitmap(ids: DataFrame, id: Column, bits: int) -> Broadcast:
    """The bits of pmod(id, 2 ** bits) of every row, as a broadcast numpy array of bytes."""
    slot = F.pmod(id, F.lit(1 << bits)) + 1
    parts = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        piece = np.frombuffer(row.bits, np.uint8)
        at = (row.part - 1) * 4096
        out[at : at + len(piece)] = piece[: len(out) - at]
    return ids.sparkSession.sparkContext.broadcast(out)


def asked_for(map_: Broadcast, ids: np.ndarray) -> np.ndarray:
    """Which of these int64 ids may be wanted."""
    has = map_.value
    slot = ids.view(np.uint64) & np.uint64(8 * len(has) - 1)
    return (has[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
