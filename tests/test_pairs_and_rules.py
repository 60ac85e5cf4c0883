"""Block-wise self-joins, rule arithmetic at large counts, labels, and the checkpoint folder."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.pairs import block_join
from shelfspark.operators import baskets
from shelfspark.operators.content import content_vectors
from shelfspark.operators.profile import edge_labels


def test_block_join_meets_every_pair_once_and_spreads_a_hot_key(spark):
    rows = spark.range(600).select(F.lit(1).alias("t"), F.col("id").alias("item")).unionByName(
        spark.range(40).select((F.col("id") % 20 + 2).cast("int").alias("t"), F.col("id").alias("item")))
    pairs = block_join(rows, rows, "t", "item", block=100).select("x.t", F.col("x.item").alias("a"), F.col("y.item").alias("b"), "x._i", "x._j")
    assert pairs.count() == pairs.distinct().count() == 600 * 600 + 20 * 4
    assert pairs.select("t", "a", "b").distinct().count() == 600 * 600 + 20 * 4
    cells = pairs.where("t = 1").groupBy("_i", "_j").count().collect()
    assert len(cells) == 36 and max(r["count"] for r in cells) < 3 * 100 * 100
    few = rows.where("item < 10")
    assert block_join(few, rows, "t", "item", block=100).where("x.t = 1").count() == 10 * 600


def test_lift_of_large_counts_and_exact_thresholds(spark):
    big = spark.createDataFrame([(1, 2, 2 * 10**9, 3 * 10**9, 5 * 10**9, 10**11)], "item_a long, item_b long, n_ab long, n_a long, n_b long, n long")
    for r in baskets.rules_from_pairs(big, "lift").collect():
        assert r["lift"] == pytest.approx(1e11 * 2e9 / (3e9 * 5e9))
    some = spark.createDataFrame([(1, 2, 22, 100, 88, 1000), (3, 4, 25, 100, 100, 1000)], big.schema)
    got = {(r["antecedent"], r["consequent"]) for r in baskets.rules_from_pairs(some, "confidence", 0.25).collect()}
    assert got == {(2, 1), (3, 4), (4, 3)}


def test_edge_labels_round_half_even_and_small_edges():
    assert edge_labels([0.125, 1.0]) == ["0.12-1.00"]
    assert edge_labels([0.0012344, 0.5, 2.0]) == ["0.00-0.50", "0.50-2.00"]
    assert edge_labels([899.1234, 1000.0]) == ["899.12-1000.00"]


def test_duplicate_product_in_the_catalog_raises(m1):
    import dataclasses
    with pytest.raises(ValueError):
        content_vectors(dataclasses.replace(m1, products=m1.products.unionByName(m1.products.limit(1))))


def test_no_local_checkpoint_folder_on_a_cluster():
    from shelfspark.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_pattern_growth_counts_the_same_pairs_and_spreads_a_large_basket(spark, m1):
    import dataclasses
    lines = spark.range(300).select(F.lit("big").alias("transaction_id"), F.concat(F.lit("i"), F.col("id")).alias("product_id")).unionByName(
        spark.range(400).select(F.concat(F.lit("t"), F.col("id") % 60).alias("transaction_id"),
                                F.concat(F.lit("i"), (F.col("id") * 7) % 41).alias("product_id"))).unionByName(
        spark.range(30).select(F.concat(F.lit("c"), F.col("id") % 10).alias("transaction_id"),
                               F.concat(F.lit("i"), F.floor(F.col("id") / 10)).alias("product_id")))
    tables = dataclasses.replace(m1, transactions=lines)
    for least in (1, 2, 3, None):
        want = sorted(map(tuple, baskets.frequent_pairs(tables, min_count=least).collect()))
        for segment in (16, 256):
            got = baskets.fpgrowth_pairs(tables, min_count=least, segment=segment)
            assert got.columns == ["item_a", "item_b", "n_ab", "n_a", "n_b", "n"]
            assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 0
    none = dataclasses.replace(m1, transactions=lines.where("false"))
    assert baskets.fpgrowth_pairs(none).count() == 0
