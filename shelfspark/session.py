"""Session helpers: one place for the configuration the jobs assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. The session time zone must be UTC so that
# whole-day differences between naive timestamps never cross a DST change.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove reliable-checkpoint files once the frame that owns them is garbage collected,
    # so a long pipeline does not accumulate every intermediate it ever materialized
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "shelfspark",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster call it without ``master`` and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # single JVM: the driver heap is the only memory there is
            conf.setdefault("spark.driver.memory", os.environ.get("SHELFSPARK_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` must name shared storage: a folder of one machine
    would be lost to the others, so a missing setting is an error there. Only a local
    master gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {sc.master} it must name a folder all executors share")
        configured = tempfile.mkdtemp(prefix="shelfspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Fact rows of a shuffle partition, before adaptive execution merges small ones.
SHUFFLE_ROWS = 250_000
#: Bytes of input or of merged shuffle partitions that a task reads: compressed rows of two ids and a count take a hundred times that in an
#: aggregation and the sort after it.
TASK_INPUT, TASK_SHUFFLE = 16 << 20, 8 << 20
_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, n_rows: int) -> None:
    """Let shuffles start with as many partitions as ``n_rows`` fact rows need, and at least as many as the session asks for.

    A fixed number would make the memory of a task grow with the input; adaptive execution merges what is too small but cuts no aggregation.
    It merges up to TASK_SHUFFLE bytes, and a scan reads up to TASK_INPUT bytes, so that their aggregations stay small as well.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_FIRST_PARTITIONS, str(max(least, -(-n_rows // SHUFFLE_ROWS))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_SHUFFLE))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_INPUT))


def widen_shuffles(spark: SparkSession, tasks: int) -> None:
    """Let shuffles start with at least ``tasks`` partitions: what a join makes may need more of them than the facts do."""
    first = int(spark.conf.get(_FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_FIRST_PARTITIONS, str(max(first, tasks)))


def materialize(df):
    """Reliable checkpoint without computing the plan twice.

    ``checkpoint()`` runs one job to fill the checkpoint files and, unless the
    data is cached, recomputes the plan to write them. Persisting first makes
    the write read the cached blocks; the cache is dropped once the
    checkpoint (in the shared ``spark.checkpoint.dir``) exists, so later stages
    and retries after a lost executor read the checkpoint files.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist(blocking=False)
    return out


def stored(df, name: str = "table"):
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back: one job, and the lineage is cut.

    The folder goes when the session's file system closes, or earlier by ``forget``.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df) -> None:
    """Delete the folder of a stored frame that nothing reads any more."""
    remove(df.sparkSession, df.stored_at)


def delete_on_exit(spark, path: str) -> None:
    _fs(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))


def remove(spark, path: str) -> None:
    _fs(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _fs(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
