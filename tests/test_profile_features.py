import datetime as dt

import pytest

from shelfspark.operators import features as FE
from shelfspark.operators import profile as PR
from tests.conftest import rows


def test_summary(m1):
    r = PR.eda_summary(m1).first().asDict()
    assert r["n_transactions"] == 6 and r["n_customers"] == 4 and r["n_products"] == 4
    assert r["n_customers_with_transactions"] == 3 and r["n_products_with_transactions"] == 3
    assert r["date_span_days"] == 9 and r["avg_transactions_per_customer"] == 2.0
    assert r["avg_quantity"] == 1.5 and r["avg_price"] == pytest.approx(11.666667, abs=1e-6)


def test_sparsity(m1):
    assert PR.eda_sparsity(m1).first()["sparsity"] == pytest.approx(0.6875)


def test_weekly(m1):
    assert rows(PR.eda_weekly(m1), "period", "count") == [(dt.date(2025, 1, 5), 2), (dt.date(2025, 1, 12), 3)]


def test_weekly_gap_weeks_are_zero(spark, m1):
    txn = spark.createDataFrame(
        [(t,) for t in ["2024-12-30T00:00:00", "2025-01-05T23:30:00", "2025-01-06T00:00:00", "2025-01-22T00:00:00"]],
        "ts string").selectExpr("'T' AS transaction_id", "'A' AS customer_id", "'P1' AS product_id",
                                "1.0 AS quantity", "1.0 AS price", "to_timestamp(ts) AS timestamp")
    got = rows(PR.eda_weekly(m1.with_transactions(txn)), "period", "count")
    assert got == [(dt.date(2025, 1, 5), 2), (dt.date(2025, 1, 12), 1), (dt.date(2025, 1, 19), 0),
                   (dt.date(2025, 1, 26), 1)]


def test_price_histogram(m1):
    got = rows(PR.eda_price_histogram(m1), "bin", "count")
    assert got == [(1, 4), (2, 0), (3, 2)]
    lo = PR.eda_price_histogram(m1).where("bin = 1").first()["range_lo"]
    assert lo == pytest.approx(4.985)


def test_price_histogram_constant(spark, m1):
    txn = m1.transactions.selectExpr("transaction_id", "customer_id", "product_id", "quantity",
                                     "5.0 AS price", "timestamp")
    r = PR.eda_price_histogram(m1.with_transactions(txn)).collect()
    assert len(r) == 1 and r[0]["count"] == 6
    assert (r[0]["range_lo"], r[0]["range_hi"]) == pytest.approx((4.995, 5.005))


def test_basket_category_segment(m1):
    assert rows(PR.eda_basket_size(m1), "basket_size", "count") == [(1, 2), (2, 2)]
    assert rows(PR.category_breakdown(m1), "category", "count") == [("x", 4), ("y", 2)]
    assert rows(PR.segment_breakdown(m1), "segment", "count") == [("s1", 5)]


def test_top_products(m1):
    assert rows(PR.eda_top_products(m1), "rank", "product_id", "count") == [(1, "P1", 2), (2, "P2", 2), (3, "P3", 2)]


def test_behavioral_temporal(m1):
    assert rows(FE.behavioral(m1.transactions), "customer_id", "total_spend", "n_orders", "n_distinct_products") == [
        ("A", 30.0, 2, 2), ("B", 25.0, 1, 2), ("C", 60.0, 1, 1)]
    assert rows(FE.temporal(m1.transactions), "customer_id", "recency_days") == [("A", 0), ("B", 0)]


def test_net_demand_search_promo(m1):
    assert rows(FE.net_demand(m1.transactions, m1.returns), "product_id", "net_demand") == [
        ("P1", 2.0), ("P2", 2.0), ("P3", 4.0), ("P9", -1.0)]
    assert rows(FE.search_intent(m1.search_logs), "customer_id", "n_searches") == [("A", 1), ("C", 0)]
    got = dict(rows(FE.promo_rate(m1.transactions, m1.promotions), "customer_id", "promo_purchase_rate"))
    assert got["A"] == pytest.approx(2 / 3) and got["B"] == 0.0 and got["C"] == 0.0


def test_side_features_standardized(m1):
    cust, ccols, prod, pcols = FE.side_features(m1)
    assert ccols[:4] == ["total_spend", "n_orders", "n_distinct_products", "recency_days"]
    for c in ccols:
        vals = [r[c] for r in cust.collect()]
        assert abs(sum(vals)) < 1e-9
    assert prod.count() == 3 and "net_demand" in pcols
