"""A filter of bounded size that tells which rows can't be among some keys, as column functions.

The keys' hashes set bits of a table of 64-bit words, at most ``2 ** (MOST_BITS - 6)`` of them, which is
joined by broadcast: rows whose bit isn't set are surely not among the keys. Where there are more keys than
bits the filter lets more rows through, but never loses one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.scratch import Scratch

MOST_BITS = 24


@dataclass(frozen=True)
class Members:
    words: DataFrame
    bits: int

    @classmethod
    def of(cls, keys: DataFrame, key: Column, scratch: Scratch) -> Members:
        """``key``: a bigint of evenly spread bits."""
        keys = scratch.cut(keys.select(key.alias("key")))
        bits = min(MOST_BITS, max(12, (16 * keys.count()).bit_length()))
        place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        words = keys.select(F.shiftright(place, 6).cast("int").alias("__at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
        return cls(scratch.cut(words.groupBy("__at").agg(F.expr("bit_or(bit)").alias("__word"))), bits)

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows that may be among the keys, and rows that surely aren't."""
        place = key.bitwiseAND(F.lit((1 << self.bits) - 1).cast("bigint"))
        marked = rows.withColumn("__place", place)
        marked = marked.join(F.broadcast(self.words), F.shiftright("__place", 6).cast("int") == F.col("__at"), "left")
        hit = F.expr("coalesce(shiftrightunsigned(__word, cast(__place & 63 as int)) & 1, 0) = 1")
        return marked.where(hit).select(*(F.col(f"`{c}`") for c in rows.columns)), marked.where(~hit).select(*(F.col(f"`{c}`") for c in rows.columns))
