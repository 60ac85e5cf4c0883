import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import get_session  # noqa: E402
from shelfspark.sources.tables import RetailTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app_name="shelfspark-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(s):
    return dt.datetime.fromisoformat(s) if s else None


@pytest.fixture(scope="session")
def m1(spark):
    """Micro-fixture M1 (FIXTURES.md §3): string ids, one unparseable timestamp."""
    txn = spark.createDataFrame(
        [("T1", "A", "P1", 1.0, 10.0, "2025-01-01T10:00:00"),
         ("T1", "A", "P2", 2.0, 5.0, "2025-01-01T10:00:00"),
         ("T2", "A", "P1", 1.0, 10.0, "2025-01-10T09:00:00"),
         ("T3", "B", "P2", 1.0, 5.0, "2025-01-10T12:00:00"),
         ("T3", "B", "P3", 1.0, 20.0, "2025-01-10T12:00:00"),
         ("T4", "C", "P3", 3.0, 20.0, "junk")],
        "transaction_id string, customer_id string, product_id string, quantity double, price double, "
        "timestamp string")
    from shelfspark.sources.tables import _coerce
    txn = _coerce("transactions", txn)
    customers = spark.createDataFrame([("A", "s1"), ("B", "s1"), ("C", None), ("D", "s2")],
                                      "customer_id string, segment string")
    products = spark.createDataFrame(
        [("P1", "x", "k1", 10.0), ("P2", "x", "k2", 5.0), ("P3", "y", None, None), ("P4", "y", "k1", 7.0)],
        "product_id string, category string, brand string, price double")
    returns = spark.createDataFrame([("T1", "P2", "A", dt.date(2025, 1, 5)), ("T9", "P9", "A", dt.date(2025, 1, 6))],
                                    "transaction_id string, product_id string, customer_id string, return_date date")
    promotions = spark.createDataFrame([("P1", 10.0, dt.date(2024, 1, 1), dt.date(2024, 1, 8))],
                                       "product_id string, discount_pct double, start_date date, end_date date")
    search = spark.createDataFrame([("A", "q", None), ("A", None, None), ("C", None, None)],
                                   "customer_id string, query string, timestamp timestamp")
    return RetailTables(transactions=txn, customers=customers, products=products, returns=returns,
                        promotions=promotions, search_logs=search)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
