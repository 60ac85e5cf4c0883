"""Data profiling (EDA): summary scalars, sparsity, top products, weekly counts,
price histogram, basket sizes, category / segment breakdowns.

Scalars are one-row frames assembled from scalar subqueries (each subquery is
a partial + final aggregation; no join, no cross product). Breakdowns
pre-aggregate the facts per product / customer before joining the dimension,
so the join sees at most one row per key instead of one per line item.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.ranking import top_k
from shelfspark.functions.timecols import whole_days
from shelfspark.sources.tables import OPTIONAL_TABLES, RetailTables

# Histogram bin count, top-products length, lowest-edge widening (0.1 % of range).
N_BINS = 10
TOP_PRODUCTS = 10
EDGE_ADJUST = 0.001


def _one_row(txn: DataFrame, **cols: Column) -> DataFrame:
    return txn.sparkSession.range(1).select(*[c.alias(n) for n, c in cols.items()])


def eda_summary(tables: RetailTables) -> DataFrame:
    """n_transactions (rows), n_customers / n_products (dimension tables, distinct),
    n_*_with_transactions (distinct in facts), date_span_days (whole days, null without a
    valid timestamp), avg_transactions_per_customer (rows per customer), avg_quantity, avg_price."""
    txn = tables.transactions
    facts = txn.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_transactions"),
        F.count_distinct("customer_id").cast("bigint").alias("n_customers_with_transactions"),
        F.count_distinct("product_id").cast("bigint").alias("n_products_with_transactions"),
        whole_days(F.min("timestamp"), F.max("timestamp")).cast("bigint").alias("date_span_days"),
        F.try_divide(F.count("customer_id").cast("double"),
                     F.count_distinct("customer_id").cast("double")).alias("avg_transactions_per_customer"),
        F.avg("quantity").alias("avg_quantity"),
        F.avg("price").alias("avg_price"),
    )
    n_cust = tables.customers.select(F.count_distinct("customer_id").cast("bigint")).scalar()
    n_prod = tables.products.select(F.count_distinct("product_id").cast("bigint")).scalar()
    return facts.select("n_transactions", n_cust.alias("n_customers"), n_prod.alias("n_products"),
                        "n_customers_with_transactions", "n_products_with_transactions", "date_span_days",
                        "avg_transactions_per_customer", "avg_quantity", "avg_price")


def eda_sparsity(tables: RetailTables) -> DataFrame:
    """1 − distinct (customer, product) pairs / (n_customers · n_products); 1.0 when either is 0.

    Null pairs count as a pair (as a distinct over both columns does). The
    denominator comes from the dimension tables, so unknown ids in the facts
    can make the result negative.
    """
    txn = tables.transactions
    n_pairs = txn.select("customer_id", "product_id").distinct().select(F.count(F.lit(1))).scalar()
    n_cust = tables.customers.select(F.count_distinct("customer_id")).scalar()
    n_prod = tables.products.select(F.count_distinct("product_id")).scalar()
    denom = n_cust.cast("double") * n_prod.cast("double")
    return _one_row(txn, n_interactions=n_pairs.cast("bigint"),
                    sparsity=F.when((n_cust == 0) | (n_prod == 0), F.lit(1.0))
                    .otherwise(F.lit(1.0) - n_pairs.cast("double") / denom))


def eda_top_products(tables: RetailTables, k: int = TOP_PRODUCTS) -> DataFrame:
    """Top-k products by number of fact rows (ties: id ascending)."""
    counts = (tables.transactions.where(F.col("product_id").isNotNull())
              .groupBy("product_id").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    return top_k(counts, [], "count", "product_id", k).select(
        F.col("rank").cast("int").alias("rank"), "product_id", "count")


def week_ending_sunday(ts: Column) -> Column:
    """The Sunday on or after the timestamp's date (weeks end Sunday, Sunday inclusive)."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "Sun")


def eda_weekly(tables: RetailTables) -> DataFrame:
    """Fact rows per week ending Sunday; empty weeks inside the range emit 0; null
    timestamps dropped; no valid timestamp gives no rows.

    The spine of weeks is generated from the min / max week (two scalar
    subqueries over the already-aggregated weekly counts), so it is bounded by
    the time span, not by the data volume.
    """
    txn = tables.transactions
    counts = (txn.where(F.col("timestamp").isNotNull())
              .groupBy(week_ending_sunday(F.col("timestamp")).alias("period"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    lo = counts.select(F.min("period")).scalar()
    hi = counts.select(F.max("period")).scalar()
    spine = (txn.sparkSession.range(1)
             .select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 7 DAYS"))).alias("period"))
             .where(F.col("period").isNotNull()))
    return (spine.join(counts, "period", "left")
            .select("period", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count")))


def edge_labels(edges: list[float]) -> list[str]:
    """``left-right`` of neighbouring edges, two decimals, of edges rounded to 3 decimals (below 1: to 3 significant
    digits), or to more where that would make two of them equal."""
    def cut(x: float, digits: int) -> float:
        if x == 0 or not math.isfinite(x):
            return x
        whole = abs(x) >= 1
        return float(np.round(x, digits if whole else digits - 1 - math.floor(math.log10(abs(x)))))

    for digits in range(3, 20):
        shown = [cut(x, digits) for x in edges]
        if len(set(shown)) == len(edges):
            break
    return [f"{x:.2f}-{y:.2f}" for x, y in zip(shown, shown[1:])]


def eda_price_histogram(tables: RetailTables, n_bins: int = N_BINS, with_label: bool = True) -> DataFrame:
    """E5: equal-width price histogram, right-closed bins, zero bins kept.

    ``min(n_bins, distinct prices)`` bins; the lowest edge is widened left by
    0.1 % of the range; a constant price gives one bin of ±0.1 % around it.
    Bin membership is decided against the same edges ``lo + i·step`` a
    linspace produces, so values on an edge land in the lower bin.

    Three numbers (least and largest price, distinct prices) reach the driver; the edges are constants of the one
    counting pass, and the result has at most ``n_bins`` rows.
    """
    spark = tables.transactions.sparkSession
    prices = tables.transactions.where(F.col("price").isNotNull()).select(F.col("price").cast("double").alias("price"))
    lo, hi, distinct = prices.agg(F.min("price"), F.max("price"), F.count_distinct("price")).first()
    schema = "bin long, range_lo double, range_hi double, range string"
    nb = min(n_bins, distinct)
    if not nb:
        spine, bins = spark.createDataFrame([], schema), F.lit(1)
    else:
        first = lo - (hi - lo) * EDGE_ADJUST
        if lo == hi:
            wide = abs(lo) * EDGE_ADJUST if lo else EDGE_ADJUST
            first = lo = lo - wide
            hi += wide
        step = (hi - lo) / nb
        edges = [first, *(i * step + lo for i in range(1, nb)), hi]
        spine = spark.createDataFrame([(i + 1, edges[i], edges[i + 1], label) for i, label in enumerate(edge_labels(edges))], schema)
        p = F.col("price")
        b = F.least(F.greatest(F.ceil((p - lo) / step), F.lit(1)), F.lit(nb))
        bins = (b - F.when((b > 1) & (p <= (b - 1) * step + lo), 1).otherwise(0)
                + F.when((b < nb) & (p > b * step + lo), 1).otherwise(0))
    counts = prices.groupBy(bins.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    out = spine.join(counts, "bin", "left").select(
        "bin", F.round("range_lo", 6).alias("range_lo"), F.round("range_hi", 6).alias("range_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"), "range")
    return out if with_label else out.drop("range")


def eda_basket_size(tables: RetailTables) -> DataFrame:
    """Rows per transaction (not distinct products), then number of baskets per size."""
    sizes = (tables.transactions.where(F.col("transaction_id").isNotNull())
             .groupBy("transaction_id").agg(F.count(F.lit(1)).alias("basket_size")))
    return sizes.groupBy(F.col("basket_size").cast("bigint").alias("basket_size")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))


def _breakdown(txn: DataFrame, dim: DataFrame, key: str, attr: str, out: str) -> DataFrame:
    per_key = (txn.where(F.col(key).isNotNull()).groupBy(key)
               .agg(F.count(F.lit(1)).alias("_n")))
    d = dim.where(F.col(attr).isNotNull()).select(key, F.col(attr).alias(out))
    return (per_key.join(d, key).groupBy(out)
            .agg(F.sum("_n").cast("bigint").alias("count")))


def category_breakdown(tables: RetailTables, category_col: str = "category") -> DataFrame:
    """Fact rows per product category (null / unknown category dropped; duplicate product rows fan out)."""
    return _breakdown(tables.transactions, tables.products, "product_id", category_col, "category")


def segment_breakdown(tables: RetailTables, segment_col: str = "segment") -> DataFrame:
    """Fact rows per customer segment (null / unknown segment dropped)."""
    return _breakdown(tables.transactions, tables.customers, "customer_id", segment_col, "segment")


def optional_tables_present(tables: RetailTables) -> DataFrame:
    """Which optional tables were supplied, with their row counts (0 when absent)."""
    parts = []
    for n in OPTIONAL_TABLES:
        df = getattr(tables, n)
        cnt = df.select(F.count(F.lit(1)).cast("bigint")).scalar() if df is not None else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(n).alias("table"), F.lit(df is not None).alias("present"), cnt.alias("n_rows")))
    return tables.transactions.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("t")).select("t.*")


def run_eda(tables: RetailTables) -> dict[str, DataFrame]:
    """All profile outputs, lazily; the caller decides what to materialise."""
    out = {
        "summary": eda_summary(tables),
        "sparsity": eda_sparsity(tables),
        "top_products": eda_top_products(tables),
        "transactions_over_time": eda_weekly(tables),
        "price_distribution": eda_price_histogram(tables),
        "basket_size_distribution": eda_basket_size(tables),
        "optional_files_present": optional_tables_present(tables),
    }
    if "category" in tables.products.columns:
        out["category_breakdown"] = category_breakdown(tables)
    if "segment" in tables.customers.columns:
        out["segment_breakdown"] = segment_breakdown(tables)
    return out
