"""Bitmaps of keys: what may be in a set, in a bounded number of bytes for every task; joins by key drop what only seems to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most (16 MB), whatever the number of keys.
MOST_BITS = 1 << 27


def key_bits(n: int, most: int = MOST_BITS) -> int:
    """Bits for n keys: a power of two, at least sixteen for each up to the bound."""
    return min(most, max(1 << 18, 1 << (16 * n).bit_length()))


def bitmap(keys: DataFrame, number: Column, bits: int) -> bytes:
    """The bitmap of the keys whose non-negative ``number`` modulo ``bits`` is their bit."""
    bit = F.pmod(number, F.lit(bits))
    blocks = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("map"))
    out = bytearray(bits // 8)
    for r in blocks.toLocalIterator():  # at most bits / 32768 rows
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = r["map"]
    return bytes(out)
