"""Result tables kept by (run, key): replacement of single keys (S9) and point lookups.

A table is cut into buckets by a hash of its key, one sorted Parquet file a bucket, with a Bloom filter and page statistics on the
key. ``upsert`` reads only the buckets its keys fall in, takes those keys' old rows out, adds the new ones and writes each
touched bucket as a new version; then one manifest file names, for each touched bucket, the version that counts from now on. So readers see
either none or all of a write, what a failed write left behind is never read, and a repeated write gives the same table.
A key that is written with no row keeps its old rows; ``delete`` names keys that lose theirs. One writer at a time per run.

``lookup`` reads the buckets of the asked keys only, and of those files only the row groups that can hold them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shelfspark.session import forget, stored
from shelfspark.sources.results import SERVE_K

BUCKETS = 64
MANIFEST = StructType([StructField("bucket", IntegerType()), StructField("number", LongType()), StructField("version", StringType())])


class KeyedTable:
    """One result table of one run, kept by ``key``. ``buckets`` must be the same for all writers and readers of it."""

    def __init__(self, spark: SparkSession, base: str, table: str, run_id: str, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = f"{base.rstrip('/')}/{table}/run_id={run_id}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, str]:
        """The version that counts of each bucket: a row per bucket, whatever the table's size."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        last = rows.groupBy("bucket").agg(F.max(F.struct("number", "version")).alias("m")).collect()
        self._number = max(r["m"]["number"] for r in last)
        return {r["bucket"]: r["m"]["version"] for r in last if r["m"]["version"]}

    def _files(self, versions: dict[int, str], buckets=None) -> list[str]:
        wanted = versions if buckets is None else [b for b in buckets if b in versions]
        return [f"{self.path}/data/version={versions[b]}/bucket={b}" for b in sorted(wanted)]

    def read(self) -> DataFrame | None:
        """The whole table; None if nothing was written."""
        files = self._files(self.versions())
        return self.spark.read.parquet(*files) if files else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the keys in ``keys`` (a column of the key's name), a bounded list: a request, not a table."""
        asked = [(r["k"], r["b"]) for r in keys.select(F.col(self.key).alias("k"), self._bucket().alias("b")).dropna().distinct().collect()]
        files = self._files(self.versions(), {b for _, b in asked})
        return self.spark.read.parquet(*files).where(F.col(self.key).isin([k for k, _ in asked])) if files else None

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew."""
        old = self.versions()
        self._publish(rows, set(old))

    def upsert(self, rows: DataFrame, delete: DataFrame | None = None) -> None:
        """Replace the keys of ``rows``, and drop the keys of ``delete``; other keys stay. Rows without a key are not written."""
        rows = stored(rows.where(F.col(self.key).isNotNull()), "upsert")
        keys = rows.select(self.key)
        keys = (keys if delete is None else keys.unionByName(delete.select(self.key))).distinct()
        touched = {r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most the buckets
        files = self._files(self.versions(), touched)
        if files:
            old = self.spark.read.parquet(*files).join(keys, self.key, "left_anti")
            merged = stored(old.select(rows.columns).unionByName(rows), "upsert")
            self._publish(merged, touched)
            forget(merged)
        else:
            self._publish(rows, touched)
        forget(rows)

    def _publish(self, rows: DataFrame, touched: set[int]) -> None:
        """Write the buckets of ``rows`` as one version, then name it; of the ``touched`` buckets those without rows are empty now."""
        version = uuid.uuid4().hex
        cut = rows.withColumn("bucket", self._bucket())
        (cut.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key, *[c for c in ("rank",) if c in rows.columns])
         .write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
         .option(f"parquet.bloom.filter.expected.ndv#{self.key}", "100000").parquet(f"{self.path}/data/version={version}"))
        # told from what was written: asking ``rows`` would compute them again
        written = self.spark.read.schema("bucket int").parquet(f"{self.path}/data/version={version}")
        filled = {r["bucket"] for r in written.select("bucket").distinct().collect()}
        number = getattr(self, "_number", -1) + 1
        told = [(b, number, version if b in filled else None) for b in sorted(touched | filled)]
        if told:
            self.spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            self._number = number


def _listed(found: DataFrame | None, like: DataFrame, k: int) -> DataFrame:
    return like.limit(0) if found is None else found.where(F.col("rank") <= k)


def get_personalized(customers: DataFrame, lists: KeyedTable, popular: KeyedTable, k: int = SERVE_K) -> DataFrame:
    """S12 for some customers: their stored list, or the overall popular one where they have none."""
    asked = customers.select("customer_id").distinct()
    overall = asked.sparkSession.createDataFrame([("overall",)], "list_key string")
    out = "customer_id", F.col("rank").cast("int").alias("rank"), "product_id", "source"
    found, fallback = lists.lookup(asked), popular.lookup(overall)
    parts = []
    if found is not None:
        parts.append(found.where(F.col("rank") <= k).withColumn("source", F.lit("personalized")).select(*out))
    if fallback is not None:
        short = F.collect_list(F.struct("rank", "product_id")).alias("l")  # at most k rows
        best = fallback.where(F.col("rank") <= k).select(short).scalar()
        missing = asked if found is None else asked.join(found.select("customer_id"), "customer_id", "left_anti")
        parts.append(missing.select("customer_id", F.explode(best).alias("r"))
                     .select("customer_id", F.col("r.rank").cast("int").alias("rank"), F.col("r.product_id").alias("product_id"), F.lit("popularity_fallback").alias("source")))
    if not parts:
        raise ValueError("neither lists nor popular products are stored for the run")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def get_fbt(products: DataFrame, fbt: KeyedTable, k: int = SERVE_K) -> DataFrame | None:
    """S13 for some products; an unknown one has no rows."""
    found = fbt.lookup(products.select(F.col("product_id").alias("item")))
    return found and found.where(F.col("rank") <= k).select(F.col("item").alias("product_id"), F.col("rank").cast("int").alias("rank"),
                                                            F.col("recommended").alias("recommended_id"))


def get_popular(segments: DataFrame, popular: KeyedTable, k: int = SERVE_K) -> DataFrame | None:
    """S14 for some segments: the segment's list, or the overall one where there is none; the asked segment is echoed."""
    asked = segments.select(F.col("segment").cast("string").alias("segment")).dropna().distinct()
    asked = asked.withColumn("list_key", F.concat(F.lit("segment:"), F.col("segment")))
    every = asked.select("list_key").unionByName(asked.sparkSession.createDataFrame([("overall",)], "list_key string"))
    found = popular.lookup(every)
    if found is None:
        return None
    found = found.where(F.col("rank") <= k).select("list_key", "rank", "product_id")
    named = asked.join(found.select(F.col("list_key").alias("has")).distinct(), F.col("list_key") == F.col("has"), "left")
    return (named.select("segment", F.coalesce("has", F.lit("overall")).alias("list_key"),
                         F.when(F.col("has").isNull(), "overall_fallback").otherwise("segment").alias("source"))
            .join(found, "list_key").select("segment", F.col("rank").cast("int").alias("rank"), "product_id", "source"))
