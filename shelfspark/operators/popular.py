"""Popular products: recency-weighted (default) and trending velocity, overall and per segment.

Output is long form ``(list_key, rank, product_id, score)`` where ``list_key``
is ``overall`` or ``segment:<value>``.

Plan shape: one pass over the facts with map-side partial aggregation per
product (or per segment and product), so the shuffle carries at most
``#products`` rows per map task; ``now`` is a scalar subquery (no join).
The per-segment lists first reduce the facts to per-(customer, product)
partial sums (so a customer holding a third of all rows becomes at most one
row per product), then join ``customers`` on ``customer_id`` and re-aggregate
per (segment, product); Spark broadcasts the customers side only when its
measured size is under the broadcast threshold, otherwise it is a shuffle join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.ranking import rounded, top_k
from shelfspark.functions.timecols import whole_days
from shelfspark.sources.tables import RetailTables

# Half-life of the recency decay and the trending windows, in days.
HALFLIFE_DAYS = 30.0
RECENT_DAYS = 7
PRIOR_DAYS = 14
TOP_K = 10


def _now(txn: DataFrame) -> Column:
    return txn.select(F.max("timestamp")).scalar()


def _segmented(partials: DataFrame, customers: DataFrame, segment_col: str) -> DataFrame:
    """Attach each customer's segment to per-(customer, product) partial sums.

    Callers pre-aggregate the facts per (customer, product) first, so a customer
    holding a large share of all rows reaches this join as at most one row per
    product. Rows with no / null segment are dropped (they form no list).
    """
    seg = (customers.where(F.col(segment_col).isNotNull())
           .select("customer_id", F.col(segment_col).alias("_segment")))
    return partials.join(seg, "customer_id")


def _finish(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    ranked = top_k(scored, keys, "score", "product_id", k)
    list_key = F.concat(F.lit("segment:"), F.col("_segment").cast("string")) if keys else F.lit("overall")
    return ranked.select(list_key.alias("list_key"), F.col("rank").cast("int").alias("rank"),
                         "product_id", rounded("score").alias("score"))


# ---------------------------------------------------------------- Q1 / Q2

def recency_weight(ts: Column, now: Column, halflife_days: float = HALFLIFE_DAYS) -> Column:
    """exp(-ln2 * max(0, whole days to now) / half-life); a null timestamp weighs 1.0."""
    days = F.greatest(F.lit(0), whole_days(ts, now))
    return F.when(ts.isNull(), F.lit(1.0)).otherwise(F.exp(F.lit(-math.log(2)) * days / F.lit(halflife_days)))


def _recency_scores(txn: DataFrame, keys: list[str], now: Column, halflife_days: float) -> DataFrame:
    weighted = txn.where(F.col("product_id").isNotNull()).select(
        *keys, "product_id",
        (F.col("quantity") * recency_weight(F.col("timestamp"), now, halflife_days)).alias("w"))
    return weighted.groupBy(*keys, "product_id").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("score"))


def popular_recency(tables: RetailTables, segment_col: str | None = "segment", top_k_: int = TOP_K,
                    halflife_days: float = HALFLIFE_DAYS, overall: bool = True,
                    segments: bool = True) -> DataFrame:
    """Q1/Q2: Σ quantity · recency weight per product; top-K overall and per segment.

    ``now`` is the global latest timestamp, also for the segment lists.
    Segment lists are skipped when the customers table lacks the column.
    """
    txn = tables.transactions
    now = _now(txn)
    parts = []
    if overall:
        parts.append(_finish(_recency_scores(txn, [], now, halflife_days), [], top_k_))
    if segments and segment_col and segment_col in tables.customers.columns:
        partial = _recency_scores(txn.where(F.col("customer_id").isNotNull()), ["customer_id"], now, halflife_days)
        seg = (_segmented(partial, tables.customers, segment_col)
               .groupBy("_segment", "product_id").agg(F.sum("score").alias("score")))
        parts.append(_finish(seg, ["_segment"], top_k_))
    return _union(parts)


# ---------------------------------------------------------------- Q3 / Q4

def _velocity_scores(txn: DataFrame, keys: list[str], now: Column) -> DataFrame:
    ts = F.col("timestamp")
    recent_start = now - F.make_dt_interval(F.lit(RECENT_DAYS))
    prior_start = now - F.make_dt_interval(F.lit(PRIOR_DAYS))
    valid = txn.where(ts.isNotNull() & F.col("product_id").isNotNull())
    agg = valid.groupBy(*keys, "product_id").agg(
        F.coalesce(F.sum(F.when(ts > recent_start, F.col("quantity"))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.sum(F.when((ts > prior_start) & (ts <= recent_start), F.col("quantity"))),
                   F.lit(0.0)).alias("prior"))
    return agg.withColumn("score", F.try_divide(F.col("recent") - F.col("prior"), F.col("prior") + 1))


def popular_trending(tables: RetailTables, segment_col: str | None = "segment", top_k_: int = TOP_K,
                     overall: bool = True, segments: bool = True) -> DataFrame:
    """Q3/Q4: (recent 7 days − prior 7 days) / (prior + 1) per product, top-K.

    Windows are (now−7d, now] and (now−14d, now−7d]; every product with any
    valid-timestamp row is ranked, zero and negative velocities included.
    Null-timestamp rows are dropped. ``now`` stays global for segments.
    """
    txn = tables.transactions
    now = _now(txn)
    parts = []
    if overall:
        parts.append(_finish(_velocity_scores(txn, [], now), [], top_k_))
    if segments and segment_col and segment_col in tables.customers.columns:
        partial = (_velocity_scores(txn.where(F.col("customer_id").isNotNull()), ["customer_id"], now)
                   .drop("score"))
        seg = (_segmented(partial, tables.customers, segment_col)
               .groupBy("_segment", "product_id").agg(F.sum("recent").alias("recent"), F.sum("prior").alias("prior"))
               .withColumn("score", F.try_divide(F.col("recent") - F.col("prior"), F.col("prior") + 1)))
        parts.append(_finish(seg, ["_segment"], top_k_))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_quantity_top(txn: DataFrame, k: int = TOP_K) -> DataFrame:
    """Plain Σ quantity top-K (no recency): the evaluation baseline list ``(rank, product_id, score)``."""
    agg = (txn.where(F.col("product_id").isNotNull()).groupBy("product_id")
           .agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("score")))
    return top_k(agg, [], "score", "product_id", k).select(
        F.col("rank").cast("int").alias("rank"), "product_id", rounded("score").alias("score"))


POPULAR_DISPATCH = {
    "recency_weighted": popular_recency,
    "trending_velocity": popular_trending,
}
DEFAULT_POPULAR = "recency_weighted"
