"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import ensure_checkpoint_dir

#: The six ASCII white-space characters, as a regex class that Java, RE2 and Python read alike.
SPACE = r"[\x20\x09-\x0D]"
#: A key's share of all rows from which its rows are joined by broadcast: at most this many keys can have it.
HOT_KEYS = 1024
#: Rows of a batch that travels between the JVM and Python: whole texts are in them, so it is what a worker and its buffers hold at a time.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand unused memory of this Python worker back: an idle worker would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(fn):
    """A batch function that gives memory back at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()
    return run


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage without computing the plan twice, in a place every executor sees.
    The folder goes when the session's file system closes.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def packed(df: DataFrame, row: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it cannot clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join ``rows`` with one row per key from ``groups``; ``size`` counts the rows of a key, ``total`` all rows.

    Keys with at least 1/HOT_KEYS of all rows are at most HOT_KEYS in number, so they are broadcast and their
    rows stay where they are; the others shuffle, and none of those has more than 1/HOT_KEYS of the rows.
    """
    limit = max(1, total // HOT_KEYS)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    hot_keys = hot.select(F.col(key))
    return (rows.join(F.broadcast(hot), key)
            .unionByName(rows.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key)))
