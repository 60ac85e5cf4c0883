"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. Groups of at least 1/ITEMS of all bytes are items of
their own (there are at most ITEMS); all other groups fall by hash into ITEMS chunks, each an item with the bytes of
its groups. So at most 2 * ITEMS items, whatever the corpus, reach the one task that differences them: partial
partitions (one sum per shard) wait in a heap by spread; the two of largest spread are combined, the largest sum of one
with the smallest of the other, until one partition is left. Every row then finds its shard from its own hash and a
broadcast of the items; rows shuffle once, without texts, to be numbered within their shards.

A null text counts as empty; size is its UTF-8 bytes plus 1. Null or repeated ids, ties and extra columns change
nothing; an empty table gives an empty result. A group larger than a fair share makes its shard larger: it is
not split.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, written

ITEMS = 8192


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item by the largest differencing method. Ties go by item number, so the result is fixed."""
    if not sizes:
        return []
    # a partial partition: sums in falling order, and for each sum the items below it as a tree of pairs
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (shards - 1), [(i,)] + [()] * (shards - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, in_a = heapq.heappop(heap)
        _, j, b, in_b = heapq.heappop(heap)
        both = [(x + y, (p, q)) for x, y, p, q in zip(a, reversed(b), in_a, reversed(in_b), strict=True)]
        both.sort(key=lambda x: -x[0])
        sums = [x[0] for x in both]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), min(i, j), sums, [x[1] for x in both]))
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            node = todo.pop()
            for x in node:
                if isinstance(x, tuple):
                    todo.append(x)
                else:
                    out[x] = shard
    return out


def _differencing(shards: int):
    def run(batches):
        rows = [r for b in batches for r in zip(b.column("item").to_pylist(), b.column("size").to_pylist(), strict=True)]
        rows.sort()
        shard = difference([int(s) for _, s in rows], shards)
        yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in rows], pa.string()),
                                          "shard": pa.array(shard, pa.int32())})
    return run


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               items: int = ITEMS) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per row of ``df``; slots run from 0 in each shard."""
    t = text_or_empty(text_col)
    rows = written(df.select(F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                             F.crc32(t.cast("binary")).alias("crc"), F.unhex(F.sha2(t, 256)).alias("grp"))
                   .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shards")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    heavy = F.col("size") * items >= F.lit(total)
    chunk = F.concat(F.lit("c"), F.pmod(F.xxhash64("grp"), F.lit(items)))
    item = F.when(heavy, F.concat(F.lit("g"), F.hex("grp"))).otherwise(chunk)
    sums = groups.select(item.alias("item"), "size").groupBy("item").agg(F.sum("size").alias("size"))
    placed = written(sums.repartition(1).mapInArrow(_differencing(shards), "item string, shard int"), "shard-items")
    alone = placed.where("item like 'g%'").select(F.unhex(F.substring("item", 2, 64)).alias("grp"), F.col("shard").alias("own"))
    chunks = placed.where("item like 'c%'").select(F.col("item").alias("chunk"), F.col("shard").alias("shared"))
    found = (rows.join(F.broadcast(alone), "grp", "left").withColumn("chunk", chunk)
             .join(F.broadcast(chunks), "chunk", "left")
             .select("id", "size", "crc", "part", "at", F.coalesce("own", "shared").alias("shard")))
    found = found.select("*", (F.row_number().over(Window.partitionBy("part", "shard").orderBy("at")) - 1).alias("k"))
    counts = found.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = counts.select("part", "shard", before.alias("before"))
    return (found.join(offsets, ["part", "shard"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("before") + F.col("k")).alias("slot")))
