"""Result tables and serving.

Results are long-form Parquet tables partitioned by ``run_id`` and written
with dynamic partition overwrite, so re-running a run replaces only its own
partition (a keyed upsert at partition granularity):

* ``personalized``: customer_id, rank, product_id, score, source
* ``fbt``:          item, rank, recommended, score, source
* ``popular``:      list_key, rank, product_id, score
* ``run_metrics``:  run_id, computed_at, list, k, metric, value  (appended)

Serving is batch joins over these tables; the popularity fallback attaches a
list of at most K rows (a scalar subquery returning one array) to each
customer without a personalized list — no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: lists are served cut to this length.
SERVE_K = 10


def write_result(df: DataFrame, base: str, table: str, run_id: str) -> None:
    """Write one result table for ``run_id``, replacing only that run's partition."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_id").parquet(f"{base.rstrip('/')}/{table}"))


def read_result(spark: SparkSession, base: str, table: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{base.rstrip('/')}/{table}")
    return df if run_id is None else df.where(F.col("run_id") == run_id)  # partition pruning


def metrics_rows(run_id: str, metrics: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """Long rows ``(run_id, computed_at, list, k, metric, value)`` from an evaluation frame; ``computed_at``
    defaults to now."""
    computed_at = F.current_timestamp() if computed_at is None else computed_at
    long = metrics.select("list", "k", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
          for m in ("precision", "recall", "hit_rate")])).alias("m"))
    return long.select(F.lit(run_id).alias("run_id"), computed_at.alias("computed_at"),
                       "list", "k", "m.metric", "m.value")


def append_metrics(df: DataFrame, base: str) -> None:
    df.write.mode("append").parquet(f"{base.rstrip('/')}/run_metrics")


def read_metrics(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame:
    """The stored metrics of a run, or of all."""
    df = spark.read.parquet(f"{base.rstrip('/')}/run_metrics")
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the latest ``computed_at`` among completed runs (one row)."""
    done = runs.where(F.col("status") == "completed") if "status" in runs.columns else runs
    return done.agg(F.max_by("run_id", "computed_at").alias("run_id"), F.max("computed_at").alias("computed_at"))


def serve_personalized(customers: DataFrame, personalized: DataFrame, popular: DataFrame,
                       k: int = SERVE_K) -> DataFrame:
    """For every requested customer, their list (``source='personalized'``) or, when they have
    no row at all, the overall popular list (``source='popularity_fallback'``), cut to ``k``.

    Deliberate choice: the fallback applies whenever a customer has no rows
    (long-form lists have no empty-list rows).
    """
    req = customers.select("customer_id").distinct()
    have = (personalized.where(F.col("rank") <= k)
            .join(req, "customer_id", "left_semi")
            .select("customer_id", "rank", "product_id", F.lit("personalized").alias("source")))
    overall = (popular.where((F.col("list_key") == "overall") & (F.col("rank") <= k))
               .select(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("l")).scalar())
    missing = req.join(personalized.select("customer_id"), "customer_id", "left_anti")
    fb = (missing.select("customer_id", F.explode(overall).alias("r"))
          .select("customer_id", F.col("r.rank").cast("int").alias("rank"), F.col("r.product_id").alias("product_id"),
                  F.lit("popularity_fallback").alias("source")))
    return have.select("customer_id", F.col("rank").cast("int").alias("rank"), "product_id", "source") \
        .unionByName(fb)


def serve_fbt(products: DataFrame, fbt: DataFrame, k: int = SERVE_K) -> DataFrame:
    """List for every requested product; an unknown product yields no rows (an empty list)."""
    req = products.select(F.col("product_id").alias("item")).distinct()
    return (fbt.where(F.col("rank") <= k).join(req, "item", "left_semi")
            .select(F.col("item").alias("product_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("recommended").alias("recommended_id")))


def serve_popular(segments: DataFrame, popular: DataFrame, k: int = SERVE_K) -> DataFrame:
    """Each requested segment gets ``segment:<s>`` when that list exists, else the overall
    list; the requested segment is echoed back."""
    req = segments.select(F.col("segment").cast("string").alias("segment")).distinct() \
        .withColumn("list_key", F.concat(F.lit("segment:"), F.col("segment")))
    lists = popular.where(F.col("rank") <= k)
    known = req.join(lists.select("list_key").distinct(), "list_key", "left_semi")
    unknown = req.join(lists.select("list_key").distinct(), "list_key", "left_anti")
    hit = known.join(lists, "list_key").select("segment", "rank", "product_id", F.lit("segment").alias("source"))
    overall = (lists.where(F.col("list_key") == "overall")
               .select(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("l")).scalar())
    miss = (unknown.select("segment", F.explode(overall).alias("r"))
            .select("segment", F.col("r.rank").alias("rank"), F.col("r.product_id").alias("product_id"),
                    F.lit("overall_fallback").alias("source")))
    return hit.unionByName(miss).select("segment", F.col("rank").cast("int").alias("rank"), "product_id", "source")


def export_flat(ranked: DataFrame, key: str, item: str, k: int = SERVE_K) -> DataFrame:
    """One row per key with its recommendations in rank order joined by ``", "``."""
    agg = (ranked.where(F.col("rank") <= k).groupBy(key)
           .agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col(item).cast("string").alias("v"))))
                .alias("_l")))
    return agg.select(key, F.array_join(F.transform("_l", lambda s: s["v"]), ", ").alias("recommendations"))
