"""Frequently bought together: baskets, frequent pairs, association rules, co-occurrence.

Items are products by default; any product attribute (brand, category) can
stand in for the product (``level``), which mines rules between brands or
categories with the same code.

Plan shape for the Apriori path (the default):
1. distinct ``(transaction_id, item)`` rows — one shuffle, duplicates collapse;
2. item counts, kept when frequent (support ≥ max(2/n, 0.01), checked in
   integers: ``count ≥ 2`` and ``100·count ≥ n``);
3. a semi join keeps only frequent items before the pair self-join, so the
   pair step never sees an infrequent item;
4. the self-join on ``transaction_id`` with ``a < b`` emits each basket's
   pairs once. A large basket is cut into blocks of items and joined block by
   block (``functions.pairs``), so no task receives the whole quadratic pair
   set of a hot basket.
Rules, thresholds and per-antecedent top-K are then small per-pair arithmetic
and a WindowGroupLimit.

Products with no rule get a co-occurrence list instead (the fallback); the
anti join that finds them runs *before* the pair self-join, so only their
pairs are produced.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.pairs import block_join
from shelfspark.functions.ranking import dense_positions, rounded, top_k
from shelfspark.session import materialize, stored
from shelfspark.sources.tables import RetailTables

# Support floor (1 % of baskets, at least 2 baskets) and rule thresholds.
MIN_SUPPORT_FRACTION = 0.01
MIN_SUPPORT_BASKETS = 2
LIFT_THRESHOLD = 1.0
CONFIDENCE_THRESHOLD = 0.3
TOP_K = 10


def basket_items(tables: RetailTables, level: str = "product_id") -> DataFrame:
    """B1: distinct ``(transaction_id, item)`` rows; ``level`` is ``product_id`` or a products column."""
    txn = tables.transactions.where(F.col("transaction_id").isNotNull() & F.col("product_id").isNotNull())
    lines = txn.select("transaction_id", "product_id").distinct()
    if level == "product_id":
        return lines.select("transaction_id", F.col("product_id").alias("item"))
    attr = tables.products.where(F.col(level).isNotNull()).select("product_id", F.col(level).alias("item"))
    return lines.join(attr, "product_id").select("transaction_id", "item").distinct()


def basket_count(tables: RetailTables) -> Column:
    """Number of baskets (distinct non-null transaction ids) as a scalar subquery."""
    return (tables.transactions.where(F.col("transaction_id").isNotNull())
            .select(F.count_distinct("transaction_id")).scalar())


def _is_frequent(cnt: Column, n: Column, min_count: int | None) -> Column:
    if min_count is not None:
        return cnt >= F.lit(min_count)
    return (cnt >= F.lit(MIN_SUPPORT_BASKETS)) & (cnt * F.lit(int(round(1 / MIN_SUPPORT_FRACTION))) >= n)


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("n_item"))


def frequent_pairs(tables: RetailTables, level: str = "product_id", min_count: int | None = None,
                   items: DataFrame | None = None) -> DataFrame:
    """B2: frequent itemsets of size 2 with their counts: ``item_a < item_b, n_ab, n_a, n_b, n``.

    ``min_count`` replaces the default support rule (max(2/n, 0.01)) by a plain basket count.
    """
    items = items if items is not None else stored(basket_items(tables, level), "basket-items")
    n = basket_count(tables)
    freq = item_counts(items).where(_is_frequent(F.col("n_item"), n, min_count))
    kept = stored(items.join(freq.select("item"), "item", "left_semi"), "frequent-items")
    pairs = (block_join(kept, kept, "transaction_id", "item").where(F.col("x.item") < F.col("y.item"))
             .groupBy(F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"))
             .agg(F.count(F.lit(1)).cast("bigint").alias("n_ab"))
             .where(_is_frequent(F.col("n_ab"), n, min_count)))
    fa = freq.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    fb = freq.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    return pairs.join(fa, "item_a").join(fb, "item_b").select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", n.cast("bigint").alias("n"))


def rules_from_pairs(pairs: DataFrame, metric: str = "lift", threshold: float | None = None) -> DataFrame:
    """Both directions of every frequent pair with support, confidence and lift, thresholded.

    lift ≥ t is tested as ``n·n_ab ≥ t·n_a·n_b`` and confidence ≥ t as
    ``n_ab ≥ t·n_a``, ``t`` being the fraction that its decimal digits say, on exact integers.
    """
    fwd = pairs.select(F.col("item_a").alias("antecedent"), F.col("item_b").alias("consequent"),
                       "n_ab", F.col("n_a").alias("n_ante"), F.col("n_b").alias("n_cons"), "n")
    bwd = pairs.select(F.col("item_b").alias("antecedent"), F.col("item_a").alias("consequent"),
                       "n_ab", F.col("n_b").alias("n_ante"), F.col("n_a").alias("n_cons"), "n")
    r = fwd.unionByName(bwd)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    double = lambda c: F.col(c).cast("double")
    if metric == "lift":
        t = Fraction(str(LIFT_THRESHOLD if threshold is None else threshold))
        keep = wide("n") * wide("n_ab") * t.denominator >= wide("n_ante") * wide("n_cons") * t.numerator
    elif metric == "confidence":
        t = Fraction(str(CONFIDENCE_THRESHOLD if threshold is None else threshold))
        keep = wide("n_ab") * t.denominator >= wide("n_ante") * t.numerator
    else:
        raise ValueError(f"unknown rule metric {metric!r}")
    return r.where(keep).select(
        "antecedent", "consequent", "n_ab",
        (F.col("n_ab") / F.col("n")).alias("support"),
        (F.col("n_ab") / F.col("n_ante")).alias("confidence"),
        # each factor is widened before the product: the products of two counts outgrow a bigint
        ((double("n") * double("n_ab")) / (double("n_ante") * double("n_cons"))).alias("lift"))


def cooccurrence(tables: RetailTables, level: str = "product_id", only: DataFrame | None = None,
                 items: DataFrame | None = None) -> DataFrame:
    """Number of distinct baskets holding both ``item`` and ``other`` (item ≠ other).

    ``only`` (a frame with an ``item`` column) restricts the left item before
    the self-join, so pairs are produced just for those items.
    """
    items = items if items is not None else stored(basket_items(tables, level), "basket-items")
    left = items if only is None else items.join(only.select("item"), "item", "left_semi")
    return (block_join(left, items, "transaction_id", "item").where(F.col("x.item") != F.col("y.item"))
            .groupBy(F.col("x.item").alias("item"), F.col("y.item").alias("other"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def _ranked(df: DataFrame, score: str, source: str, k: int) -> DataFrame:
    r = top_k(df.withColumn("score", F.col(score).cast("double")), ["item"], "score", "recommended", k)
    return r.select("item", F.col("rank").cast("int").alias("rank"), "recommended",
                    rounded("score").alias("score"), F.lit(source).alias("source"))


def fbt_from_rules(tables: RetailTables, rules: DataFrame, metric: str, level: str, k: int,
                   items: DataFrame | None = None) -> DataFrame:
    """B5–B7 + B9: per antecedent top-K by the metric; items with no rule get top-K co-occurrence."""
    ranked = _ranked(rules.select(F.col("antecedent").alias("item"), F.col("consequent").alias("recommended"),
                                  metric), metric, f"rule_{metric}", k)
    items = items if items is not None else basket_items(tables, level)
    all_items = items.select("item").distinct()
    missing = all_items.join(rules.select(F.col("antecedent").alias("item")), "item", "left_anti")
    co = cooccurrence(tables, level, only=missing, items=items)
    fallback = _ranked(co.select("item", F.col("other").alias("recommended"), "n"), "n", "cooccurrence", k)
    return ranked.unionByName(fallback)


def fbt_apriori(tables: RetailTables, metric: str = "lift", k: int = TOP_K, level: str = "product_id",
                min_count: int | None = None) -> DataFrame:
    """Apriori-style rules (itemsets of size ≤ 2) ranked by ``metric``, with the co-occurrence fallback."""
    # the distinct (basket, item) rows feed the item counts, both pair self-join sides and the
    # fallback: store them once so the facts are scanned and joined once
    items = materialize(basket_items(tables, level))
    rules = rules_from_pairs(frequent_pairs(tables, level, min_count, items=items), metric)
    return fbt_from_rules(tables, rules, metric, level, k, items=items)


def fbt_apriori_lift(tables: RetailTables, k: int = TOP_K, level: str = "product_id") -> DataFrame:
    """B5 (default variant)."""
    return fbt_apriori(tables, "lift", k, level)


def fbt_apriori_confidence(tables: RetailTables, k: int = TOP_K, level: str = "product_id") -> DataFrame:
    """B6."""
    return fbt_apriori(tables, "confidence", k, level)


SEGMENT = 256


def fpgrowth_pairs(tables: RetailTables, level: str = "product_id", min_count: int | None = None,
                   items: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """The same frequent pairs by pattern growth, stopped at itemsets of size 2.

    Frequent items are numbered by falling count; a basket is its numbers in that order, and the prefix before an item is
    that item's conditional basket, so every pair is counted once, under its rarer item. Equal baskets are merged with
    their multiplicity before a prefix is unfolded. No longer itemset is grown.

    A basket of more than ``segment`` frequent items is cut into segments by number, one row of at most ``segment`` numbers
    each. Prefixes across two segments meet by an equi-join on (basket, later segment, earlier segment), so the
    pairs of one basket spread over tasks and no basket is one row.
    """
    items = items if items is not None else materialize(basket_items(tables, level))
    n = basket_count(tables)
    freq = item_counts(items).where(_is_frequent(F.col("n_item"), n, min_count))
    ranks = materialize(dense_positions(freq, [F.col("n_item").desc(), F.col("item").asc()], "rank"))
    kept = items.join(ranks.select("item", "rank"), "item").select("transaction_id", "rank")
    large = (kept.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > segment)
             .select("transaction_id", F.lit(True).alias("_large")))
    last = F.floor((ranks.select(F.max("rank")).scalar() - 1) / segment)
    cut = F.when(F.col("_large"), F.floor((F.col("rank") - 1) / segment)).otherwise(0)
    segments = materialize(
        kept.join(large, "transaction_id", "left").withColumn("seg", cut.cast("long"))
        .groupBy("transaction_id", "seg").agg(F.sort_array(F.collect_list("rank")).alias("own"),
                                              F.first("_large").alias("_large")))

    merged = segments.groupBy("own").agg(F.count(F.lit(1)).alias("m"))
    inside = (merged.select("own", "m", F.posexplode("own").alias("i", "hi"))
              .select("hi", "m", F.explode(F.slice("own", F.lit(1), F.col("i"))).alias("lo")))

    cells = segments.where("_large")
    later = cells.where(F.col("seg") > 0).select(
        "transaction_id", F.col("seg").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seg") - 1)).alias("t"), "own")
    earlier = cells.where(F.col("seg") < last).select(
        "transaction_id", F.col("seg").alias("t"), F.explode(F.sequence(F.col("seg") + 1, last)).alias("s"), F.col("own").alias("before"))
    across = (later.join(earlier, ["transaction_id", "s", "t"])
              .select(F.explode("own").alias("hi"), "before").select("hi", F.lit(1).cast("bigint").alias("m"), F.explode("before").alias("lo")))

    doubles = (inside.unionByName(across).groupBy("hi", "lo").agg(F.sum("m").cast("bigint").alias("n_ab"))
               .where(_is_frequent(F.col("n_ab"), n, min_count)))
    fa = ranks.select(F.col("rank").alias("hi"), F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    fb = ranks.select(F.col("rank").alias("lo"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    first = F.col("x") < F.col("y")
    return doubles.join(fa, "hi").join(fb, "lo").select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"), n.cast("bigint").alias("n"))


def fbt_fpgrowth(tables: RetailTables, k: int = TOP_K, level: str = "product_id") -> DataFrame:
    """FP-Growth itemsets, lift ranking, co-occurrence fallback."""
    items = materialize(basket_items(tables, level))
    rules = rules_from_pairs(fpgrowth_pairs(tables, level, items=items), "lift")
    return fbt_from_rules(tables, rules, "lift", level, k, items=items)


def fbt_cooccurrence(tables: RetailTables, k: int = TOP_K, level: str = "product_id") -> DataFrame:
    """Top-K co-occurring items for every item; no mining step."""
    co = cooccurrence(tables, level)
    return _ranked(co.select("item", F.col("other").alias("recommended"), "n"), "n", "cooccurrence", k)


FBT_DISPATCH = {
    "apriori_lift": fbt_apriori_lift,
    "apriori_confidence": fbt_apriori_confidence,
    "fpgrowth": fbt_fpgrowth,
    "cooccurrence": fbt_cooccurrence,
}
DEFAULT_FBT = "apriori_lift"
