"""Sets of 64-bit hashes as bits of bounded size: a test may say yes by chance, never no to a member."""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a set for each of its members, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Bits:
    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def bit_set(hashes: DataFrame, most: int = MOST_BITS) -> Bits:
    """The set of the column h (long); the driver gets a row for each 64 bits, most / 64 at most."""
    n = hashes.count()
    size = min(most, max(1 << 12, 1 << math.ceil(math.log2(max(n, 1) * BITS_EACH))))
    slot = F.col("h").bitwiseAND(size - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    rows = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("v")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    return Bits(words)
