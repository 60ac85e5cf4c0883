"""Approximate nearest neighbours by adaptive dimension scans.

Vectors fall into lists by their nearest centroid (k-means on a bounded sample; every vector is indexed). A query first
scans its home lists, the HOME nearest ones (more, until they hold k other vectors), and so has a k-th best distance. It
carries that bound on to the other lists, of which it visits those that a test on the list does not reject: with the
distance D of query and centroid and the range of the members' distances r from it, a list can hold a nearer vector if
D^2 + r^2 - 2 D r z / sqrt(d) is within the bound squared for some r. Here z is how many standard deviations a member's
direction may lean towards the query: LEAN times the quantile that one of n random directions exceeds, so it follows the
size of the table. Where vectors cluster this leaves few lists, where they do not it leaves many.

Within a list vectors are rotated by one random orthogonal matrix and read in blocks of columns. After m of d columns the
part of a squared distance read so far has a Beta(m/2, (d-m)/2) share of the whole; a candidate is abandoned if that part
exceeds the squared k-th best so far times this share's mean and DOUBT standard deviations (at most 1: then it is certain).
Rows come in batches that start at FIRST rows and double, the k-th best falls after each. Survivors
get the exact distance on the original vectors, in double precision. The rotated distances only decide whom to abandon.

Lists are cut into cells of bounded vectors and queries, so a list that holds a third of all vectors is work for many
tasks, and each cell keeps k per query before anything is merged.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id or with
another length than most. Rows that repeat an id count once (the least vector). Ids may have any type that sorts; ties go
to the smaller id. With fewer candidates than k all are returned; no queries or an empty table give an empty result. Extra
columns are ignored. Very long vectors make smaller cells.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import written

SAMPLE, LIST, MOST_LISTS, ROUNDS, HOME, LEAN = 8192, 64, 1024, 12, 4, 0.58
BLOCK, FIRST, BATCH, GROUP, DOUBT = 16, 64, 1024, 128, 2.5
#: Values of the vectors of a cell, and queries of a cell.
CELL, QUERIES = 1 << 18, 1024
#: Values of the pairs whose exact distances are taken at a time.
PAIRS = 1 << 22


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = _squares(sample, centre).argmin(axis=1)
        for j in np.unique(near):
            centre[j] = sample[near == j].mean(axis=0)
    return centre


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y``, up to rounding."""
    return np.maximum((x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _tested(rq: np.ndarray, rx: np.ndarray, bound: np.ndarray, slack: np.ndarray, tally: list | None):
    """(query, row) of the pairs that no test abandons; ``bound``: the k-th best distance of each query."""
    d = rx.shape[1]
    share = lambda to: min(1.0, to / d + DOUBT * np.sqrt(2 * to * (d - to) / (d + 2)) / d)
    limit = lambda to: share(to) * bound ** 2 + slack
    to = min(d, BLOCK)
    partial = _squares(rq[:, :to], rx[:, :to])
    qi, xi = np.nonzero(~(partial > limit(to)[:, None]) if to < d else np.ones(partial.shape, bool))
    partial, read = partial[qi, xi], to * len(rq) * len(rx)
    for block in range(to, d, BLOCK):
        to = min(d, block + BLOCK)
        read += (to - block) * len(qi)
        if to < d:  # is the whole distance still plausibly within the k-th best?
            partial += ((rx[xi, block:to] - rq[qi, block:to]) ** 2).sum(axis=1)
            keep = ~(partial > limit(to)[qi])
            qi, xi, partial = qi[keep], xi[keep], partial[keep]
    if tally is not None:
        tally[0] += len(rq) * len(rx)
        tally[1] += len(rq) * len(rx) - len(qi)
        tally[2] += read
    return qi, xi


def scan(q: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray, order: np.ndarray, tally: list | None = None):
    """(query, row, distance) of the k nearest rows of ``x`` found for each row of ``q`` within its ``bound``.

    ``own``: the row of x that is the query itself, or -1. Ties go to the smaller ``order``. ``tally`` adds up pairs met,
    pairs abandoned and columns read of all pairs.
    """
    turn = rotation(x.shape[1])
    rx, rq, longest = x @ turn, q @ turn, (x ** 2).sum(axis=1).max(initial=0)
    out = []
    for a in range(0, len(q), GROUP):
        some = np.arange(a, min(a + GROUP, len(q)))
        slack = 1e-9 * ((q[some] ** 2).sum(axis=1) + longest)  # equal vectors may differ by rounding once rotated
        best, qb, xb, db = bound[some].copy(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST
        while at < len(x):
            to = min(at + step, len(x))
            qi, xi = _tested(rq[some], rx[at:to], best, slack, tally)
            xi = xi + at
            keep = xi != own[some][qi]
            qi, xi = qi[keep], xi[keep]
            near, chunk = np.empty(len(qi)), max(1, PAIRS // x.shape[1])
            for c in range(0, len(qi), chunk):
                near[c:c + chunk] = np.sqrt(((x[xi[c:c + chunk]] - q[some[qi[c:c + chunk]]]) ** 2).sum(axis=1))
            keep = near <= bound[some][qi]
            qb, xb, db = np.concatenate([qb, qi[keep]]), np.concatenate([xb, xi[keep]]), np.concatenate([db, near[keep]])
            by = np.lexsort((order[xb], db, qb))
            qb, xb, db = qb[by], xb[by], db[by]
            rank = np.arange(len(qb)) - np.searchsorted(qb, qb)
            qb, xb, db, rank = qb[rank < k], xb[rank < k], db[rank < k], rank[rank < k]
            best[qb[rank == k - 1]] = db[rank == k - 1]
            at, step = to, min(2 * step, BATCH)
        out.append((some[qb], xb, db))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _assign(centre: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), centre.shape[1])
                near = _squares(x, centre).argmin(axis=1)
                away = np.sqrt(((x - centre[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near, pa.int32()), pa.array(away)], ["id", "v", "list", "away"])
    return run


def _lists(b: pa.RecordBatch, chosen: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("bound"), pa.array(chosen, pa.list_(pa.int32()))],
                                      ["id", "v", "bound", "lists"])


def _homes(far: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """The nearest HOME lists of each query, and more until they hold k vectors besides its own."""
    order = np.argsort(far, axis=1, kind="stable")
    n = np.maximum(HOME, (np.cumsum(sizes[order], axis=1) < k + 1).sum(axis=1) + 1)
    return [o[:m] for o, m in zip(order, n, strict=True)]


def leaning(n: int, d: int, lean: float = LEAN) -> float:
    """The cosine with the query's direction that a test on a list allows, for n vectors of d dimensions."""
    return min(1.0, lean * NormalDist().inv_cdf(1 - 1 / (n + 1)) / np.sqrt(d))


def may_hold(far: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, lean: float) -> np.ndarray:
    """The lists that may hold a vector within ``bound``; ``far``: squared distances of queries and centroids, ``low`` and
    ``high``: the range of the members' distances from their centroid."""
    dist = np.sqrt(far)
    r = np.clip(dist * lean, low, high)
    return far + r ** 2 - 2 * dist * r * lean <= (bound ** 2)[:, None] * (1 + 1e-9)


def _visits(centre: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, lean: float, k: int, first: bool):
    """Queries with the lists they visit: at first the home lists, then all others that may hold a nearer vector."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            far = _squares(_matrix(b.column("v"), centre.shape[1]), centre)
            homes = _homes(far, sizes, k)
            if first:
                yield _lists(b, [h[sizes[h] > 0].tolist() for h in homes])
            else:
                go = may_hold(far, b.column("bound").to_numpy(zero_copy_only=False), low, high, lean) & (sizes > 0)
                for row, h in zip(go, homes, strict=True):
                    row[h] = False
                yield _lists(b, [np.flatnonzero(row).tolist() for row in go])
    return run


def _search(d: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            id_type = (queries if len(queries) else rows).column("id").type
            return pa.table({"query_id": pa.array([], id_type), "vec_id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        rows = rows.take(pc.sort_indices(rows.column("id")))  # so that a row's number orders as its id does
        ids = rows.column("id").combine_chunks()
        own = pc.fill_null(pc.index_in(queries.column("id").combine_chunks(), value_set=ids), -1).to_numpy(zero_copy_only=False)
        shuffled = np.random.default_rng(len(ids)).permutation(len(ids))  # what is scanned first must not hang on the ids
        place = np.append(np.argsort(shuffled), -1)
        qi, xi, near = scan(_matrix(queries.column("v"), d), _matrix(rows.column("v"), d)[shuffled], k,
                            queries.column("bound").to_numpy(), place[own], shuffled)
        return pa.table({"query_id": queries.column("id").take(pa.array(qi)), "vec_id": ids.take(pa.array(shuffled[xi])), "score": pa.array(near)})
    return run


def _visit(asked: DataFrame, listed: DataFrame, held: dict, d: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest found for each query in each cell of the lists it visits."""
    spark = asked.sparkSession
    wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    cell = max(1, CELL // d)
    cells = spark.createDataFrame([(i, -(-held[i] // cell), -(-n // QUERIES)) for i, n in wanted.items()],
                                  "list int, parts int, turns int")  # at most MOST_LISTS rows
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["list", "part", "turn"]
    left = asked.join(F.broadcast(cells), "list").withColumn("turn", part("turns")).withColumn("part", every("parts"))
    right = listed.join(F.broadcast(cells), "list").withColumn("part", part("parts")).withColumn("turn", every("turns"))
    left, right = left.select(*key, "id", "v", "bound"), right.select(*key, "id", "v")
    kind = right.schema["id"].dataType.simpleString()
    return (left.groupBy(*key).cogroup(right.groupBy(*key))
            .applyInArrow(_search(d, k), f"query_id {kind}, vec_id {kind}, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           lean: float = LEAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds on ``id``.

    ``lean``: more of it visits more lists; from the square root of the dimensions on the list test is the triangle inequality.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")))
    rows = written(rows, "vectors")
    kind, id_kind = rows.schema["v"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    d, n = common["d"], common["n"]
    rows = rows.where(F.size("v") == d)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(256, (1 << 23) // d)))
    sample = np.array([r["v"] for r in some.select("v").collect()], np.float64)  # bounded by the line above
    centre = centroids(sample, int(min(MOST_LISTS, max(1, n // LIST), max(1, len(sample) // 8))))
    listed = written(rows.mapInArrow(_assign(centre), f"id {id_kind}, v {kind}, list int, away double"), "lists")
    about = {r["list"]: r for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    held = {i: r["n"] for i, r in about.items()}  # a row per list
    column = lambda c: np.array([about[i][c] if i in about else 0 for i in range(len(centre))])
    sizes, low, high = column("n"), column("low"), column("high")

    def asked(queries: DataFrame, first: bool) -> DataFrame:
        lists = queries.mapInArrow(_visits(centre, sizes, low, high, leaning(n, d, lean), k, first), f"id {id_kind}, v {kind}, bound double, lists array<int>")
        return written(lists.select("id", "v", "bound", F.explode("lists").alias("list")), "queries")

    queries = rows.where(is_query)
    home = _visit(asked(queries.withColumn("bound", F.lit(float("inf"))), True), listed, held, d, k)
    home = written(_best(home, k).select("query_id", "vec_id", "score", "rank"), "home")
    bounds = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    others = _visit(asked(queries.join(bounds, "id").select("id", "v", "bound"), False), listed, held, d, k)
    return _best(home.drop("rank").unionByName(others), k).select("query_id", "rank", "vec_id", "score")
