"""Deterministic top-K and per-key scaling.

Tie rule used by every ranking in the package: score rounded to 6 decimals,
descending, then id ascending. Rounding first keeps rankings identical across
engines whose float sums differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def rounded(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, SCORE_DIGITS)


def top_k(df: DataFrame, keys: Sequence[str], score: str, item: str, k: int,
          rank_col: str = "rank", ascending: bool = False) -> DataFrame:
    """Keep the best ``k`` rows per ``keys`` and number them 1..k.

    ``row_number() <= k`` is planned as a WindowGroupLimit, so each partition
    keeps at most k rows per key before the shuffle; with no keys it is a
    sort + limit (TakeOrderedAndProject), so no task ever holds more than k
    rows per input partition.
    """
    order = rounded(score).asc() if ascending else rounded(score).desc()
    if not keys:
        # global top-k: sort + limit plans as TakeOrderedAndProject (a top-k per partition,
        # then a merge of at most k rows per partition); only the k survivors are numbered
        top = df.orderBy(order, F.col(item).asc()).limit(k)
        return top.withColumn(rank_col, F.row_number().over(Window.orderBy(order, F.col(item).asc())))
    w = Window.partitionBy(*keys).orderBy(order, F.col(item).asc())
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k))


def minmax_within(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Min-max scale ``value`` within each key; a range under 1e-9 gives 0 for the whole key."""
    w = Window.partitionBy(*keys)
    lo = F.min(value).over(w)
    hi = F.max(value).over(w)
    return df.withColumn(
        out,
        F.when(hi - lo < F.lit(1e-9), F.lit(0.0)).otherwise((F.col(value) - lo) / (hi - lo)),
    )


def dense_positions(df: DataFrame, order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Number rows 1..n in ``order`` without pulling them into one task.

    The frame is sorted (range partitioning) and checkpointed so the order is
    fixed; each row's position is its partition's offset (prefix sum of the
    per-partition counts — one row per partition) plus its index inside the
    partition, recovered from ``monotonically_increasing_id``.
    """
    from shelfspark.session import materialize

    ordered = materialize(df.orderBy(*order)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    idx = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + idx + 1)
            .drop("_pid", "_mid", "_off"))
