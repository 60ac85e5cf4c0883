import pytest
from pyspark.sql import functions as F

from shelfspark.operators import baskets as B
from shelfspark.operators import content as C
from shelfspark.operators import evaluate as V
from shelfspark.operators import item_cf as I
from shelfspark.operators import popular as Q
from shelfspark.operators.interactions import user_item_counts
from shelfspark.sources import results as R
from tests.conftest import rows


def test_popular_recency(m1):
    got = rows(Q.popular_recency(m1), "list_key", "rank", "product_id", "score")
    assert ("overall", 1, "P3", 4.0) in got and ("overall", 2, "P2", 2.624505) in got
    assert ("overall", 3, "P1", 1.812252) in got
    seg = [g for g in got if g[0] == "segment:s1"]
    assert seg == [("segment:s1", 1, "P2", 2.624505), ("segment:s1", 2, "P1", 1.812252), ("segment:s1", 3, "P3", 1.0)]
    assert not [g for g in got if g[0] == "segment:s2"]


def test_popular_trending(m1):
    got = rows(Q.popular_trending(m1, segments=False), "product_id", "score")
    assert got == [("P1", 0.0), ("P2", -0.333333), ("P3", 1.0)]


def test_fbt_fallback_when_no_rule(m1):
    got = rows(B.fbt_apriori_lift(m1), "item", "rank", "recommended", "source")
    assert got == [("P1", 1, "P2", "cooccurrence"), ("P2", 1, "P1", "cooccurrence"), ("P2", 2, "P3", "cooccurrence"),
                   ("P3", 1, "P2", "cooccurrence")]
    assert rows(B.fbt_cooccurrence(m1), "item", "rank", "recommended") == [
        ("P1", 1, "P2"), ("P2", 1, "P1"), ("P2", 2, "P3"), ("P3", 1, "P2")]


def test_rules_with_low_support(m1):
    pairs = B.frequent_pairs(m1, min_count=1)
    r = {(x["antecedent"], x["consequent"]): x for x in B.rules_from_pairs(pairs, "lift").collect()}
    assert r[("P1", "P2")]["lift"] == pytest.approx(1.0) and r[("P1", "P2")]["confidence"] == 0.5


def test_item_similarity_and_cf(m1):
    sim = {(r["item_i"], r["item_j"]): r["sim"] for r in I.item_similarity(user_item_counts(m1.transactions)).collect()}
    assert sim[("P1", "P2")] == pytest.approx(0.707107, abs=1e-6) and sim[("P2", "P3")] == pytest.approx(0.5)
    assert ("P1", "P3") not in sim and sim[("P1", "P1")] == pytest.approx(1.0)
    got = rows(I.item_cf_topk(m1.transactions, max_items=None), "customer_id", "product_id", "score")
    assert got == [("A", "P3", 0.5), ("B", "P1", 0.707107), ("C", "P2", 0.5)]


def test_content(m1):
    vec, blocks, has_price = C.content_vectors(m1)
    z = dict(rows(vec, "product_id", "price_z"))
    assert z["P1"] == pytest.approx(1.224745, abs=1e-6) and z["P3"] == pytest.approx(0.0) and "P4" not in z
    got = rows(C.content_topk(m1), "customer_id", "rank", "product_id", "score")
    assert got == [("A", 1, "P3", 0.0), ("B", 1, "P1", -0.101015), ("C", 1, "P1", 0.0), ("C", 2, "P2", 0.0)]


def test_holdout_and_baseline(m1):
    train, test = V.holdout_split(m1.transactions)
    assert rows(test, "customer_id", "product_id") == [("A", "P1"), ("B", "P3")]
    assert rows(train, "transaction_id", "product_id") == [("T1", "P2"), ("T3", "P2"), ("T4", "P3")]
    m = {r["k"]: r for r in V.baseline_metrics(train, test).collect()}
    assert m[5]["precision"] == pytest.approx(0.1) and m[5]["recall"] == 0.5 and m[5]["hit_rate"] == 0.5
    assert m[10]["precision"] == pytest.approx(0.05)


def test_serve_personalized_fallback(spark, m1):
    lists = I.item_cf_topk(m1.transactions, max_items=None)
    got = rows(R.serve_personalized(m1.customers, lists, Q.popular_recency(m1, segments=False)),
               "customer_id", "rank", "product_id", "source")
    assert ("D", 1, "P3", "popularity_fallback") in got
    assert ("A", 1, "P3", "personalized") in got and len([g for g in got if g[0] == "D"]) == 3


def test_serve_popular_unknown_segment(spark, m1):
    segs = spark.createDataFrame([("s1",), ("zz",)], "segment string")
    got = rows(R.serve_popular(segs, Q.popular_recency(m1)), "segment", "rank", "product_id", "source")
    assert got[0] == ("s1", 1, "P2", "segment") and ("zz", 1, "P3", "overall_fallback") in got


def test_export_flat(m1):
    got = dict(rows(R.export_flat(B.fbt_cooccurrence(m1), "item", "recommended"), "item", "recommendations"))
    assert got["P2"] == "P1, P3"


def test_result_tables_dynamic_overwrite(spark, tmp_path, m1):
    base = str(tmp_path / "res")
    pop = Q.popular_recency(m1, segments=False)
    R.write_result(pop, base, "popular", "r1")
    R.write_result(pop.where(F.col("rank") == 1), base, "popular", "r2")
    R.write_result(pop.where(F.col("rank") <= 2), base, "popular", "r1")
    assert R.read_result(spark, base, "popular", "r1").count() == 2
    assert R.read_result(spark, base, "popular", "r2").count() == 1


def test_evaluation_makes_the_split_once(spark, m1):
    """The facts are read for the held-out pairs and for the train facts, not once more for each of them."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    def seen(_):
        read.add(1)
        return True
    facts = m1.transactions.where(F.udf(seen, "boolean")("transaction_id"))
    got = V.evaluate(m1.with_transactions(facts), lambda t: C.content_topk(t))
    assert read.value <= 2 * m1.transactions.count()
    want = V.evaluate(m1, lambda t: C.content_topk(t), checkpoint_split=False)
    assert rows(got, *got.columns) == rows(want, *got.columns)
