"""Sets of 64-bit keys as bitmaps of a bounded size, tested inside a scan's own stage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest bitmap that is sent to every executor, in bytes.
BITMAP_BYTES = 128 << 20

#: Bits per key while the bitmap may still grow; one key in sixteen others passes then.
BITS_PER_KEY = 16

# A block holds 2 ** 15 bits in words of 64: four kilobytes that are looked up by one join key.
_BLOCK_BITS, _WORDS = 15, 512


class Members(NamedTuple):
    blocks: DataFrame
    bits: int


def members(keys: DataFrame, limit: int = BITMAP_BYTES) -> Members:
    """The set of ``keys``, one column of longs.

    The bitmap has ``BITS_PER_KEY`` bits for each key, a power of two in all, and no more
    than ``limit`` bytes, whatever the number of keys: at 2 ** 30 bits 60 million keys keep
    the full size, and with 500 million about 40 of 100 other keys pass. A key of the set always passes, so
    the bitmap only spares work that an exact join behind it would throw away. Bits
    are combined before they are shuffled.
    """
    keys = keys.toDF("key").where("key IS NOT NULL")
    wanted = max(1, keys.count() * BITS_PER_KEY)
    bits = max(1 << _BLOCK_BITS, min(1 << (wanted - 1).bit_length(), 1 << ((limit * 8).bit_length() - 1)))
    slots = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    words = slots.groupBy(F.expr("slot >> 6").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("set")
    )
    # at most 512 words of a block
    at = F.map_from_entries(F.collect_list(F.struct(F.expr("int(word & 511)"), F.col("set"))))
    blocks = words.groupBy(F.expr("word >> 9").alias("_block")).agg(at.alias("at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("long")))
    return Members(blocks.select("_block", dense.alias("_words")), bits)


def among(table: DataFrame, key: Column, wanted: Members) -> DataFrame:
    """The rows of ``table`` whose ``key`` is in the set, and few others; nothing is shuffled."""
    slot = table.withColumn("_slot", key.bitwiseAND(F.lit(wanted.bits - 1)))
    here = F.expr(f"_block = _slot >> {_BLOCK_BITS}") & F.expr("getbit(_words[int(_slot >> 6) & 511], int(_slot & 63)) = 1")
    return slot.join(F.broadcast(wanted.blocks), here, "left_semi").drop("_slot")
