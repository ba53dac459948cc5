"""Bitmaps of hashed keys that stand before a join, so that wide rows without a partner need no shuffle.

A key sets one bit of ``BITS`` for each key, in bitmaps of ``SPAN`` bits, which are broadcast. A row whose bit is not set
has none of the keys, for certain; of other rows one in ``BITS`` passes by chance, so an exact join must follow.
Bitmaps take ``MOST`` bits (8 MB) at most; with more keys more rows pass, and results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SPAN = 1 << 15
MOST = 1 << 26


class Keys:
    """The column ``key`` of ``keys``, which is read twice; nulls are not for it."""

    def __init__(self, keys: DataFrame, key: str):
        self.key = key
        self.bits = min(MOST, max(SPAN, 1 << (BITS * keys.count()).bit_length()))
        self.maps = keys.groupBy(F.shiftright(self._at(), 15).alias("_span")).agg(F.bitmap_construct_agg(self._at().bitwiseAND(F.lit(SPAN - 1))).alias("_bits"))

    def _at(self) -> Column:
        return F.xxhash64(self.key).bitwiseAND(F.lit(self.bits - 1))

    def _joined(self, rows: DataFrame, how: str) -> DataFrame:
        at = self._at()
        byte = F.conv(F.hex(F.substring(self.maps["_bits"], F.shiftright(at.bitwiseAND(F.lit(SPAN - 1)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
        return rows.join(F.broadcast(self.maps), (F.shiftright(at, 15) == self.maps["_span"]) & is_set, how)

    def within(self, rows: DataFrame) -> DataFrame:
        """All ``rows`` with one of the keys, and a few others."""
        return self._joined(rows, "left_semi")

    def without(self, rows: DataFrame) -> DataFrame:
        """The rest of ``rows``: none has one of the keys."""
        return self._joined(rows, "left_anti")
