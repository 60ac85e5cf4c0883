"""Offline evaluation: temporal hold-out (V1), ranking metrics (V2), popularity baseline (V3), full run (V4).

Hold-out: per customer, distinct products ordered by last purchase (null
last-seen sorts last, i.e. most recent; ties by product id); the last
``min(max(1, round(0.2·n)), n−1)`` are held out; customers with fewer than two
distinct products are all train. Every fact row of a held-out (customer,
product) pair leaves train. Rows with a null customer vanish from both sides.

Metrics for k in {5, 10}: precision@k (hits / k), recall@k (hits / |held
out|), hit-rate@k, averaged over every customer with held-out items; a
customer without a list scores 0. Hits are found by joining the held-out
pairs to the ranked list on (customer, product) — never by expanding lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.popular import train_quantity_top
from shelfspark.sources.tables import RetailTables
from shelfspark.session import stored

# Metric cut-offs, hold-out share and minimum history.
TOP_K_VALUES = (5, 10)
TEST_FRACTION = 0.2
MIN_DISTINCT_PRODUCTS = 2


def held_out(txn: DataFrame) -> DataFrame:
    """V1: the held-out pairs ``(customer_id, product_id)``.

    The per-customer ordering runs on (customer, product) aggregates, so a
    customer's window holds at most one row per distinct product.
    """
    facts = txn.where(F.col("customer_id").isNotNull())
    last = (facts.where(F.col("product_id").isNotNull())
            .groupBy("customer_id", "product_id").agg(F.max("timestamp").alias("last_seen")))
    by_cust = Window.partitionBy("customer_id")
    ordered = by_cust.orderBy(F.col("last_seen").asc_nulls_last(), F.col("product_id").asc())
    ranked = (last.withColumn("pos", F.row_number().over(ordered))
              .withColumn("n", F.count(F.lit(1)).over(by_cust)))
    # round(0.2·n) for integer n never falls on .5, so it equals floor((2n + 5) / 10)
    n_test = F.least(F.greatest(F.lit(1), F.floor((F.col("n") * 2 + 5) / 10)), F.col("n") - 1)
    return (ranked.where((F.col("n") >= MIN_DISTINCT_PRODUCTS) & (F.col("pos") > F.col("n") - n_test))
            .select("customer_id", "product_id"))


def train_facts(txn: DataFrame, test: DataFrame) -> DataFrame:
    """V1: the facts of known customers without those of the held-out pairs."""
    return txn.where(F.col("customer_id").isNotNull()).join(test, ["customer_id", "product_id"], "left_anti")


def holdout_split(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1: ``(train_facts, test_pairs)``; test pairs are ``(customer_id, product_id)``."""
    test = held_out(txn)
    return train_facts(txn, test), test


def _metrics(hit: DataFrame, test: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``(k, precision, recall, hit_rate, n_customers)`` from the held-out pairs with the rank of each one that is listed."""
    rel = test.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rel"))
    per = hit.groupBy("customer_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in ks])
    per = rel.join(per, "customer_id", "left")
    long = per.select("n_rel", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("hits")) for k in ks])).alias("m"))
    return (long.groupBy(F.col("m.k").alias("k")).agg(
        F.avg(F.col("m.hits") / F.col("m.k")).alias("precision"),
        F.avg(F.col("m.hits") / F.col("n_rel")).alias("recall"),
        F.avg(F.when(F.col("m.hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.count(F.lit(1)).cast("bigint").alias("n_customers")))


def ranked_metrics(recs: DataFrame, test: DataFrame, ks: Sequence[int] = TOP_K_VALUES) -> DataFrame:
    """V2: ``(k, precision, recall, hit_rate, n_customers)`` for a ranked list ``(customer_id, rank, product_id)``."""
    return _metrics(test.join(recs.select("customer_id", "product_id", "rank"), ["customer_id", "product_id"], "left"), test, ks)


def baseline_metrics(train: DataFrame, test: DataFrame, ks: Sequence[int] = TOP_K_VALUES) -> DataFrame:
    """V3: the same top-max(k) Σ-quantity list for every test customer, owned items not removed.

    The list has max(k) rows, so hits are a join of the held-out pairs to it on
    product only; nothing is replicated per customer.
    """
    top = train_quantity_top(train, max(ks))
    return _metrics(test.join(F.broadcast(top.select("product_id", "rank")), "product_id", "left"), test, ks)


def evaluate(tables: RetailTables, recommender: Callable[[RetailTables], DataFrame],
             ks: Sequence[int] = TOP_K_VALUES, checkpoint_split: bool = True) -> DataFrame:
    """V4: split, retrain ``recommender`` on train facts only, score it and the baseline.

    ``recommender`` maps tables to ``(customer_id, rank, product_id, ...)`` with
    at least max(k) rows per customer when it can. Features and models are
    rebuilt from train (the held-out purchases never inform the model).
    Returns ``(list, k, precision, recall, hit_rate, n_customers)``; no rows
    when nobody has a held-out item.
    """
    if checkpoint_split:
        # stored one after the other, so that the split is made once: train reads the held-out pairs where they were written
        test = stored(held_out(tables.transactions), "test")
        train = stored(train_facts(tables.transactions, test), "train")
    else:
        train, test = holdout_split(tables.transactions)
    recs = recommender(tables.with_transactions(train))
    model = ranked_metrics(recs, test, ks).withColumn("list", F.lit("model"))
    base = baseline_metrics(train, test, ks).withColumn("list", F.lit("popularity_baseline"))
    return model.unionByName(base).select("list", "k", "precision", "recall", "hit_rate", "n_customers")
