"""Less data moved by a filter on keys (C3): a bitmap of one side's keys, probed before the other side is shuffled.

A key sets one of ``BITS`` bits, at its hash; the bitmap is an aggregate of at most
``BITS`` / 64 words of 64 bits, combined map-side, and is all that is broadcast, whatever
the number of keys. The other side keeps the rows whose bit is set: all rows that have a
partner, and by chance a share of the rest that is the share of set bits. Then both
sides are joined as usual, so the result is that of the plain join. The bitmap pays
where the filtered side has far fewer keys than there are bits and the other side is large; it
reads the filtered side once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.keys import div
from shoal.operators.joins import equi_join

BITS = 1 << 26          # 2^20 words: 16 MiB at most


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(bits))


def key_bitmap(df: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(_word, _mask): the words of the bitmap that have a bit set."""
    place = df.filter(F.col(key).isNotNull()).select(_place(key, bits).alias("_place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_place") % 64).cast("int"))
    return place.groupBy(div(F.col("_place"), 64).alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def probe(df: DataFrame, key: str, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose key's bit is set; null keys go."""
    tagged = df.withColumn("_place", _place(key, bits)).withColumn("_at", div(F.col("_place"), 64))
    met = tagged.join(F.broadcast(bitmap), F.col("_at") == F.col("_word"))        # one row per word: no row is repeated
    bit = F.call_function("shiftrightunsigned", F.col("_mask"), (F.col("_place") % 64).cast("int")).bitwiseAND(1)
    return met.filter((bit == 1) & F.col(key).isNotNull()).select(*(F.col(f"`{c}`") for c in df.columns))


def filtered_join(few: DataFrame, many: DataFrame, few_key: str, many_key: str, strategy: str = "auto", bits: int = BITS) -> DataFrame:
    """``few JOIN many`` where ``many`` is thinned by the bitmap of ``few``'s keys before it is shuffled."""
    return equi_join(few, probe(many, many_key, key_bitmap(few, few_key, bits), bits), few_key, many_key, strategy)
