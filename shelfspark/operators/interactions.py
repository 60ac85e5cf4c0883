"""Customer × product interactions (P1) and dense integer ids for MLlib."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfspark.functions.ranking import dense_positions
from shelfspark.operators.strata import Owned
from shelfspark.session import materialize, stored


def user_item_counts(txn: DataFrame) -> DataFrame:
    """Fact rows per (customer, product) as ``cnt`` (quantity is not used)."""
    return (txn.where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
            .groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))


def dense_ids(ids: DataFrame, col: str, out: str) -> DataFrame:
    """Map distinct values of ``col`` to 0..n-1 in sorted order (for MLlib, which needs int ids)."""
    d = ids.select(col).where(F.col(col).isNotNull()).distinct()
    return dense_positions(d, [F.col(col).asc()], "_p").select(col, (F.col("_p") - 1).cast("int").alias(out))


def int_ids(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Number ``col`` densely as ``out`` (MLlib needs int ids): the frame with ``out``, and the mapping."""
    mapping = materialize(dense_ids(df, col, out))
    return df.join(mapping, col), mapping


#: Owned pairs of a block of customers in a draw.
DRAW_PAIRS = 250_000


class Unowned:
    """Uniform draws among the products that a customer does not own.

    ``pos`` holds the owned pairs ``(uid, iid)``, each once, with products numbered 0..n-1. A draw is the r-th product not
    owned, r = h mod their number, found exactly by rank/select (``strata.Owned``) among the owned products. So nothing is drawn twice or
    given up, however much of the catalog a customer owns; one owning all of it gets no row. Owned pairs and draws meet in blocks of
    customers, as many as the pairs need, and move once; a customer's rows are bounded by the catalog, as pairs are distinct.
    """

    def __init__(self, pos: DataFrame):
        self.n_items, n_pairs = pos.select(F.count_distinct("iid"), F.count(F.lit(1))).first()
        self.blocks = -(-n_pairs // DRAW_PAIRS) or 1
        self.pos = stored(pos.select("uid", "iid"), "unowned")

    def draw(self, draws: DataFrame) -> DataFrame:
        """``(uid, tag, iid)`` for every draw ``(uid, h, tag)`` of a customer who does not own everything."""
        n_items, block = self.n_items, F.pmod(F.xxhash64("uid"), F.lit(self.blocks)).alias("block")
        kinds = StructType([StructField("uid", IntegerType()), draws.schema["tag"], StructField("iid", IntegerType())])

        def run(pos: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(pos) or not len(asked):
                return pa.table({"uid": pa.array([], pa.int32()), "tag": asked["tag"].slice(0, 0), "iid": pa.array([], pa.int32())})
            users, u = np.unique(pos["uid"].to_numpy(), return_inverse=True)
            i = pos["iid"].to_numpy().astype(np.int64)
            order = np.lexsort((i, u))
            owned = Owned(u[order], i[order], len(users), n_items)
            uid = asked["uid"].to_numpy()
            at = np.minimum(np.searchsorted(users, uid), len(users) - 1)
            able = np.flatnonzero((users[at] == uid) & (owned.free[at] > 0))
            at = at[able]
            drawn = owned.unowned(at, asked["h"].to_numpy()[able] % owned.free[at])
            return pa.table({"uid": pa.array(uid[able], pa.int32()), "tag": asked["tag"].take(pa.array(able)), "iid": pa.array(drawn, pa.int32())})
        asked = draws.select("uid", "h", "tag", block)
        return self.pos.select("uid", "iid", block).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, kinds)
