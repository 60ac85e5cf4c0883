import pytest
from pyspark.sql import functions as F

from shelfspark.sources import tables as T


def test_coerce_bad_timestamp_is_null_row_kept(m1):
    r = m1.transactions.where(F.col("transaction_id") == "T4").collect()
    assert len(r) == 1 and r[0]["timestamp"] is None


def test_missing_required_table(spark, m1):
    with pytest.raises(T.ValidationError, match="no input for the required"):
        T.check_columns({"transactions": m1.transactions, "customers": m1.customers})


def test_missing_columns(spark, m1):
    with pytest.raises(T.ValidationError, match="table products lacks"):
        T.check_columns({"transactions": m1.transactions, "customers": m1.customers,
                         "products": m1.products.drop("product_id")})
    with pytest.raises(T.ValidationError, match="optional table returns"):
        T.check_columns({"transactions": m1.transactions, "customers": m1.customers, "products": m1.products,
                         "returns": m1.returns.drop("return_date")})


def test_volume_gate(m1):
    g = {r["check"]: (r["value"], r["passed"]) for r in T.volume_gate(m1).collect()}
    assert g == {"transaction_rows": (6, False), "unique_customers": (4, False), "unique_products": (4, False)}
    with pytest.raises(T.ValidationError, match="too few transaction rows: 6 of 50"):
        T.enforce_volume_gate(m1)
    T.enforce_volume_gate(m1, min_rows=5, min_customers=4, min_products=4)


def test_extension_warnings_and_keys(m1):
    assert T.extension_warnings(m1.products, m1.customers) == []
    w = T.extension_warnings(m1.products.drop("brand"), m1.customers.drop("segment"))
    assert len(w) == 2 and "brand" in w[0] and "segment" in w[1]
    assert T.segment_key(m1.customers) == "segment" and T.segment_key(m1.customers.drop("segment")) is None
    assert T.category_key(m1.products) == "category"


def test_csv_load_roundtrip(spark, tmp_path, m1):
    paths = {}
    for name, df in m1.as_dict().items():
        p = str(tmp_path / name)
        df.select([F.col(c).cast("string") for c in df.columns]).write.option("header", True).csv(p)
        paths[name] = p
    t = T.load_tables(spark, paths, gate=False)
    assert t.present_optional() == ["returns", "search_logs", "promotions"]
    assert dict(t.transactions.dtypes)["timestamp"] == "timestamp"
    assert t.transactions.where(F.col("timestamp").isNull()).count() == 1


def test_schema_warnings_frame(spark, m1):
    from shelfspark.sources.tables import RetailTables
    t = RetailTables(m1.transactions, m1.customers.drop("segment"), m1.products)
    rows = {(r["table"], r["column"]): r for r in T.schema_warnings(spark, t).collect()}
    assert rows[("products", "brand")]["n_non_null"] == 3 and rows[("products", "brand")]["warning"] is None
    assert "segment" in rows[("customers", "segment")]["warning"]
