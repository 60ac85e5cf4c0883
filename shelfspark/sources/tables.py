"""Input tables: logical schema, loaders, validation and the test-data mapping.

The engine works on seven logical tables. Three are required
(``transactions``, ``customers``, ``products``); four are optional and switch
feature groups on when present (``sessions``, ``returns``, ``search_logs``,
``promotions``). One transactions row is one line item; a basket is every row
sharing ``transaction_id``; ``price`` is a unit price.

Id columns keep whatever type the source gives them (string or bigint).
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.timecols import parse_timestamp

# Table names, required columns and volume limits of the input contract.
REQUIRED_TABLES = ["transactions", "customers", "products"]
OPTIONAL_TABLES = ["sessions", "returns", "search_logs", "promotions"]
REQUIRED_COLUMNS = {
    "transactions": ["transaction_id", "customer_id", "product_id", "quantity", "price", "timestamp"],
    "customers": ["customer_id"],
    "products": ["product_id"],
}
OPTIONAL_COLUMNS = {
    "sessions": ["session_id", "customer_id", "product_id", "timestamp"],
    "returns": ["transaction_id", "product_id", "customer_id", "return_date"],
    "search_logs": ["customer_id", "query", "timestamp"],
    "promotions": ["product_id", "discount_pct", "start_date", "end_date"],
}
MIN_TRANSACTION_ROWS = 50
MIN_CUSTOMERS = 5
MIN_PRODUCTS = 5
# Retail extension columns: optional enrichments that only produce warnings when absent.
PRODUCT_EXTENSION = ["category", "brand"]
CUSTOMER_EXTENSION = ["segment"]

# Columns parsed as timestamps / dates / doubles when a CSV gives them as text.
_TIMESTAMP_COLS = {"transactions": ["timestamp"], "sessions": ["timestamp"], "search_logs": ["timestamp"]}
_DATE_COLS = {"returns": ["return_date"], "promotions": ["start_date", "end_date"], "customers": ["signup_date"]}
_DOUBLE_COLS = {"transactions": ["quantity", "price"], "products": ["price"], "promotions": ["discount_pct"]}


class ValidationError(Exception):
    """Input tables do not satisfy the contract."""


@dataclass(frozen=True)
class RetailTables:
    transactions: DataFrame
    customers: DataFrame
    products: DataFrame
    sessions: DataFrame | None = None
    returns: DataFrame | None = None
    search_logs: DataFrame | None = None
    promotions: DataFrame | None = None

    def present_optional(self) -> list[str]:
        return [n for n in OPTIONAL_TABLES if getattr(self, n) is not None]

    def with_transactions(self, txn: DataFrame) -> "RetailTables":
        return replace(self, transactions=txn)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


# ---------------------------------------------------------------- validation

def check_columns(tables: dict[str, DataFrame]) -> None:
    """Required tables present; required columns present in required and in given optional tables."""
    missing = [t for t in REQUIRED_TABLES if tables.get(t) is None]
    if missing:
        raise ValidationError(f"no input for the required tables {missing}")
    for name in REQUIRED_TABLES:
        cols = [c for c in REQUIRED_COLUMNS[name] if c not in tables[name].columns]
        if cols:
            raise ValidationError(f"table {name} lacks the columns {cols}")
    for name in OPTIONAL_TABLES:
        if tables.get(name) is not None:
            cols = [c for c in OPTIONAL_COLUMNS[name] if c not in tables[name].columns]
            if cols:
                raise ValidationError(f"optional table {name} is given but lacks the columns {cols}")


def volume_gate(tables: RetailTables, min_rows: int = MIN_TRANSACTION_ROWS,
                min_customers: int = MIN_CUSTOMERS, min_products: int = MIN_PRODUCTS) -> DataFrame:
    """S4 as a frame: one row per check with ``check_order, check, value, minimum, passed``.

    Three independent aggregates are stitched together as scalar subqueries, so
    the plan is three partial/final aggregations and no join.
    """
    n_rows = tables.transactions.select(F.count(F.lit(1))).scalar()
    n_cust = tables.customers.select(F.count_distinct("customer_id")).scalar()
    n_prod = tables.products.select(F.count_distinct("product_id")).scalar()
    def check(order, name, value, minimum):
        return F.struct(F.lit(order).alias("check_order"), F.lit(name).alias("check"),
                        value.cast("bigint").alias("value"), F.lit(minimum).cast("bigint").alias("minimum"))

    one = tables.transactions.sparkSession.range(1)
    rows = one.select(F.explode(F.array(
        check(1, "transaction_rows", n_rows, min_rows),
        check(2, "unique_customers", n_cust, min_customers),
        check(3, "unique_products", n_prod, min_products),
    )).alias("c")).select("c.*")
    return rows.withColumn("passed", F.col("value") >= F.col("minimum"))


def enforce_volume_gate(tables: RetailTables, **limits) -> None:
    """Raise ``ValidationError`` for the first failing volume check (three numbers reach the driver)."""
    msgs = {
        "transaction_rows": "too few transaction rows: {v} of {m}",
        "unique_customers": "too few distinct customers: {v} of {m}",
        "unique_products": "too few distinct products: {v} of {m}",
    }
    for r in volume_gate(tables, **limits).orderBy("check_order").collect():
        if not r["passed"]:
            raise ValidationError(msgs[r["check"]].format(m=r["minimum"], v=r["value"]))


def extension_warnings(products: DataFrame, customers: DataFrame) -> list[str]:
    """Soft warnings for missing retail extension columns (schema only, no job)."""
    out = [f"products has no column {c} (optional)" for c in PRODUCT_EXTENSION
           if c not in products.columns]
    out += [f"customers has no column {c} (optional)" for c in CUSTOMER_EXTENSION
            if c not in customers.columns]
    return out


def schema_warnings(spark: SparkSession, tables: RetailTables) -> DataFrame:
    """S6 as a frame: one row per retail extension column with its coverage.

    ``(table, column, present, n_rows, n_non_null, warning)``; ``warning`` is the
    soft-warning text when the column is absent (the warnings list is the
    non-null ``warning`` values). Counts are one aggregation per table.
    """
    parts = []
    for name, df, cols in (("products", tables.products, PRODUCT_EXTENSION),
                           ("customers", tables.customers, CUSTOMER_EXTENSION)):
        aggs = [F.count(F.lit(1)).cast("bigint").alias("n_rows")]
        aggs += [F.count(F.col(c)).cast("bigint").alias(f"nn_{c}") for c in cols if c in df.columns]
        st = df.select(F.struct(*aggs)).scalar()
        for c in cols:
            present = c in df.columns
            parts.append(F.struct(
                F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(present).alias("present"),
                st.getField("n_rows").alias("n_rows"),
                (st.getField(f"nn_{c}") if present else F.lit(0).cast("bigint")).alias("n_non_null"),
                F.lit(None if present else f"{name} has no column {c} (optional)")
                .cast("string").alias("warning")))
    return spark.range(1).select(F.explode(F.array(*parts)).alias("w")).select("w.*")


def segment_key(customers: DataFrame) -> str | None:
    """The customer column to segment popularity by, if present."""
    return "segment" if "segment" in customers.columns else None


def category_key(products: DataFrame) -> str | None:
    """The product column holding the category, if present."""
    return "category" if "category" in products.columns else None


# ---------------------------------------------------------------- loaders

def _coerce(name: str, df: DataFrame) -> DataFrame:
    """Type text columns; bad timestamps / numbers become null, the row is kept."""
    types = dict(df.dtypes)
    for c in _TIMESTAMP_COLS.get(name, []):
        if c in types and types[c] == "string":
            df = df.withColumn(c, parse_timestamp(F.col(c)))
    for c in _DATE_COLS.get(name, []):
        if c in types and types[c] == "string":
            df = df.withColumn(c, F.to_date(parse_timestamp(F.col(c))))
    for c in _DOUBLE_COLS.get(name, []):
        if c in types and types[c] == "string":
            df = df.withColumn(c, F.col(c).try_cast(T.DoubleType()))
    return df


def load_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "csv",
                gate: bool = True) -> RetailTables:
    """Read the given tables, validate columns and volume, coerce types.

    CSV is read with a header and every column as text (no schema inference
    pass over the data); types are then coerced leniently. Parquet keeps its
    own types. Optional tables that are not given stay ``None``.
    """
    frames: dict[str, DataFrame] = {}
    for name, path in paths.items():
        if name not in REQUIRED_TABLES + OPTIONAL_TABLES:
            continue
        if fmt == "csv":
            df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        else:
            df = spark.read.format(fmt).load(path)
        frames[name] = df
    check_columns(frames)
    frames = {n: _coerce(n, df) for n, df in frames.items()}
    tables = RetailTables(**frames)
    if gate:
        enforce_volume_gate(tables)
    return tables


# ---------------------------------------------------------------- test-data mapping

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fact_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest table, from its files' footers."""
    return _read(spark, sf_dir, "lineitem").count()


def tpch_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transactions = lineitem ⋈ orders: one line item per row, unit price not rounded."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_orderkey").alias("transaction_id"),
                      F.col("o_custkey").alias("customer_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").alias("quantity"),
                      F.try_divide("l_extendedprice", "l_quantity").alias("price"),
                      F.col("o_orderdate").alias("timestamp")))


def tpch_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


def tpch_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def _event_product() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def events_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-day transactions: purchase events, one event = one single-line basket."""
    ev = _read(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "purchase")
              .select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"),
                      _event_product().alias("product_id"), F.lit(1.0).alias("quantity"),
                      F.col("value").alias("price"), F.col("ts").alias("timestamp")))


def tpch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return (ev.where(F.col("event_type").isin("view", "click"))
              .select(F.col("event_id").alias("session_id"), F.col("user_id").alias("customer_id"),
                      _event_product().alias("product_id"), F.col("ts").alias("timestamp")))


def tpch_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (_read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_partkey", "l_shipdate"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("product_id"),
                      F.col("o_custkey").alias("customer_id"),
                      F.to_date("l_shipdate").alias("return_date")))


def tpch_search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("customer_id"),
                     F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
                      .otherwise(F.col("event_type")).alias("query"),
                     F.col("ts").alias("timestamp"))


def tpch_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_read(spark, sf_dir, "part").where(F.col("p_size") <= 12)
            .select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("double").alias("discount_pct"),
                    F.lit("2000-01-01").cast("date").alias("start_date"),
                    F.lit("2000-01-31").cast("date").alias("end_date")))


def tpch_tables(spark: SparkSession, sf_dir: str, optional: bool = True) -> RetailTables:
    """All seven logical tables over the TPC-H-style test data (lazy; nothing runs)."""
    kw = {}
    if optional:
        kw = dict(sessions=tpch_sessions(spark, sf_dir), returns=tpch_returns(spark, sf_dir),
                  search_logs=tpch_search_logs(spark, sf_dir), promotions=tpch_promotions(spark, sf_dir))
    return RetailTables(transactions=tpch_transactions(spark, sf_dir),
                        customers=tpch_customers(spark, sf_dir),
                        products=tpch_products(spark, sf_dir), **kw)
