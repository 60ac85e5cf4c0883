"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets, in a bounded bitmap, the slots that two or more texts hash to; pass 2 counts only the rows that hit such a
slot again, under an independent hash. A row outside either bitmap has a unique text: it passes straight through and
never shuffles. Only the possibly repeated rest is grouped by SHA-256, with counts and minima combined map-side.

Texts are equal when identical after each run of ASCII white space becomes one space; a null text counts as empty.
Of equal texts the row with the smallest id stays; a null id comes after all others; of rows with equal text and equal
id exactly one stays. An empty table gives an empty result. Extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.bitfilter import MAX_BITS, flag, rehash, repeated_bits, size_bits
from shelfspark.llm.common import SPACE, join_groups, packed, text_or_empty, written


def normalised(text: Column | str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE + "+", " ")


def repeated_filters(keys: DataFrame, h: str, max_bits: int = MAX_BITS) -> list[tuple[DataFrame, int]]:
    """The bitmaps of the two passes over a (stored) column of 64-bit hashes."""
    bits = size_bits(keys.count(), max_bits)
    first = (repeated_bits(keys, F.col(h), bits), bits)
    again = flag(keys.select(h), F.col(h), [first], "hit").where("hit")
    return [first, (repeated_bits(again, rehash(F.col(h), 1), bits), bits)]


def duplicate_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_bits: int = MAX_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``df``."""
    norm = normalised(F.col(text_col))
    # narrow: 64-bit hash, digest and a tag that tells repeated rows apart; the texts are read once
    keys = written(df.select(F.col(id_col).alias("id"), norm.alias("t"))
                   .select("id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"),
                           F.monotonically_increasing_id().alias("tag")), "dedup")
    flagged = flag(keys, F.col("h"), repeated_filters(keys, "h", max_bits), "maybe").drop("h")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tag"))
    unique = flagged.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                         F.lit(True).alias("kept"), "sha")
    again = flagged.where("maybe").drop("maybe")
    groups = again.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "dedup-groups")
    joined = join_groups(again, groups, "sha", "group_size", keys.count())
    told = joined.select("id", F.col("first.id").alias("keep_id"), "group_size",
                         (F.col("first.tag") == F.col("tag")).alias("kept"), "sha")
    return unique.unionByName(told).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept",
                                           F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    cols = df.columns
    keyed = df.select(packed(df), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tag"),
                      normalised(F.col(text_col)).alias("t"))
    hashes = written(keyed.select(F.xxhash64("t").alias("h")), "dedup")
    flagged = flag(keyed.select("row", "id", "tag", F.sha2("t", 256).alias("sha"), F.xxhash64("t").alias("h")), F.col("h"),
                   repeated_filters(hashes, "h", max_bits), "maybe")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("tag"))
    first = flagged.where("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    kept = flagged.where(~F.col("maybe")).select("row").unionByName(first.select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
