"""Bloom bitmaps as small tables: built by aggregation, bounded in size, tested by a broadcast join.

A bitmap has ``bits`` slots, cut into buckets of 32,768 bits (4 KB each), one row per bucket. ``bits`` follows the
number of keys up to MAX_BITS, so the broadcast side never exceeds MAX_BITS / 8 bytes; beyond that the
filter only lets more rows through, which costs time and never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import packed, written

BUCKET_BITS = 32768
MAX_BITS = 1 << 29


def size_bits(n: int, max_bits: int = MAX_BITS, per_key: int = 16) -> int:
    """A power of two of at least ``per_key`` bits for each key, within the bound."""
    bits = BUCKET_BITS
    while bits < per_key * n and bits < max_bits:
        bits *= 2
    return bits


def slot(h: Column, bits: int) -> Column:
    """1-based slot of a 64-bit hash."""
    return F.pmod(h, F.lit(bits)) + 1


def bitmap(slots: DataFrame, name: str = "slot") -> DataFrame:
    """(bucket, bitmap) with the bits of the given slots set; stored, as it is read several times."""
    s = F.col(name)
    return written(slots.groupBy(F.bitmap_bucket_number(s).alias("bucket"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position(s)).alias("bitmap")), "bitmap")


def repeated_bits(keys: DataFrame, h: Column, bits: int) -> DataFrame:
    """Bitmap of the slots that two or more rows of ``keys`` hit. Counts are combined before the shuffle."""
    hit = keys.select(slot(h, bits).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return bitmap(hit.where("n > 1").select("slot"))


def key_bits(keys: DataFrame, h: Column, bits: int) -> DataFrame:
    """Bitmap of the slots that any row of ``keys`` hits."""
    return bitmap(keys.select(slot(h, bits).alias("slot")))


def flag(df: DataFrame, h: Column, filters: list[tuple[DataFrame, int]], out: str) -> DataFrame:
    """Add the boolean ``out``: all filters hold the hash. The n-th filter takes the n-th rehash of ``h``."""
    cols = df.columns
    work = df.select(packed(df, "row"), h.alias("h"))
    found = F.lit(True)
    for i, (table, bits) in enumerate(filters):
        s = slot(rehash(F.col("h"), i), bits)
        byte = F.floor(F.bitmap_bit_position(s) / 8).cast("int")
        work = (work.withColumn("bucket", F.bitmap_bucket_number(s))
                .join(F.broadcast(table.withColumnRenamed("bitmap", f"bitmap{i}")), "bucket", "left").drop("bucket"))
        value = F.conv(F.hex(F.substring(F.col(f"bitmap{i}"), byte + 1, F.lit(1))), 16, 10).cast("int")
        found = found & F.coalesce(_bit(value, F.bitmap_bit_position(s)), F.lit(False))
    return work.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], found.alias(out))


def _bit(value: Column, position: Column) -> Column:
    power = F.pow(F.lit(2), F.pmod(position, F.lit(8))).cast("int")
    return value.bitwiseAND(power) != 0


def rehash(h: Column, i: int) -> Column:
    """The i-th independent hash of a 64-bit hash; the 0th is the hash itself."""
    return h if i == 0 else F.xxhash64(h, F.lit(i))
