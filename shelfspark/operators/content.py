"""Content-based personalized ranking (P11) over product content vectors.

Content vector of a product that occurs in the facts: one-hot category,
one-hot brand (a null level is its own ``__missing__`` level) and the price
z-score (null price → mean price of those products; population std + 1e-9).
Vectors are L2-normalised. A customer's profile is the purchase-count
weighted sum of the normalised vectors of the products they bought,
normalised again; every product the customer does not own is ranked by cosine
to the profile.

Writing ``A_c[level]`` for the profile weight of a one-hot level and ``W_c`` for its price weight, the cosine of product ``j`` is

    (A_c[category_j] + A_c[brand_j] + W_c · z_j) / (‖x_j‖ · ‖P_c‖),  ‖x_j‖ = √(#blocks + z_j²)

Products are sorted by (category, brand, z, id) and cut into blocks, a block into ``PARTS`` spans; the part of one (category, brand) in a span or
block is neighbours by z. In z the cosine rises up to z* = #blocks · W / A and falls after it, so a run of neighbours has its largest value at
z* (or at its end next to z*) and its smallest at an end. The runs taken by falling smallest value until they hold K products
not owned give a value that the K-th best reaches at least; runs whose largest value stays below it are skipped.

That is done three times. Blocks of customers meet the spans' ends only (at most ``MOST_BLOCKS * PARTS`` and one a group, however large the
catalog), first per block, then per span of the parts left (those of the largest values first, for a better bound): this gives the few blocks that may hold one of a customer's K best, and a customer
is sent to these blocks only, with the levels and owned products found there. A cell (a block and at most about ``CELL_ROWS`` such rows)
bounds pieces of at most ``PIECE`` products and scores the rest. Of spans with one and the same vector only the first with K products not
owned are looked at, as ties go to the smaller id. The cells' lists meet in one top-K per customer.

Ranking is by the exact score, then product id (not the package's rounded
rule: the bounds hold for the score itself).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from shelfspark.functions.ranking import dense_positions, rounded
from shelfspark.operators.interactions import int_ids, user_item_counts
from shelfspark.sources.tables import RetailTables
from shelfspark.session import stored

# The level used for a missing one-hot value, and the std guard.
MISSING_LEVEL = "__missing__"
STD_EPS = 1e-9
TOP_K = 10
BLOCKS = ("category", "brand")
#: Products of a block (at least), blocks (at most), spans of a block, products of a piece; (customer, product) pairs looked at in one go.
ITEM_BLOCK, MOST_BLOCKS, PARTS, PIECE, STRETCH = 1024, 512, 32, 64, 1 << 22
#: Customers and owned pairs of a block of customers, spans that it meets at once, rows of a cell (all at most, the rows about).
USER_BLOCK, USER_PAIRS, SLICE, CELL_ROWS = 16_384, 1_000_000, 1 << 18, 250_000
#: Parts of a customer whose spans are looked at first.
LOOK = 4


def content_vectors(tables: RetailTables, check_unique: bool = True) -> tuple[DataFrame, list[str], bool]:
    """``(product_id, <block levels...>, price_z, norm)`` for every product in the facts.

    Returns the frame, the one-hot block columns used, and whether a price term exists.
    A catalog listing a product twice raises ``ValueError`` (unless ``check_unique`` is off).
    """
    products = tables.products
    blocks = [b for b in BLOCKS if b in products.columns]
    has_price = "price" in products.columns
    if check_unique:
        dup = products.groupBy("product_id").count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("products table lists a product_id more than once")
    sold = tables.transactions.where(F.col("product_id").isNotNull()).select("product_id").distinct()
    cols = [F.coalesce(F.col(b).cast("string"), F.lit(MISSING_LEVEL)).alias(b) for b in blocks]
    catalog = products.select("product_id", *blocks, *(["price"] if has_price else []))
    base = sold.join(catalog, "product_id", "left").select(
        "product_id", *cols, *([F.col("price")] if has_price else []))
    if has_price:
        mean_raw = base.select(F.avg("price")).scalar()
        filled = base.withColumn("price", F.coalesce(F.col("price"), mean_raw))
        stats = filled.select(F.struct(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))).scalar()
        z = (F.col("price") - stats.getField("m")) / (stats.getField("s") + F.lit(STD_EPS))
        vec = filled.withColumn("price_z", z).drop("price")
    else:
        vec = base.withColumn("price_z", F.lit(0.0))
    if not blocks and not has_price:
        norm = F.lit(1.0)
    else:
        norm = F.sqrt(F.lit(float(len(blocks))) + F.col("price_z") * F.col("price_z"))
    return vec.withColumn("norm", norm), blocks, has_price


def _bounds(a: np.ndarray, w: np.ndarray, z_lo: np.ndarray, z_hi: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest ``(a + w z) / norm`` of runs of neighbours in z."""
    value = lambda z: (a + w * z) / (np.sqrt(nb + z * z) if nb else 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        peak = np.where(a > 0, nb * w / a, np.where(w > 0, np.inf, -np.inf))
    return value(np.clip(peak, z_lo, z_hi)), np.minimum(value(z_lo), value(z_hi))


def reached_pieces(a: np.ndarray, w: np.ndarray, z_lo: np.ndarray, z_hi: np.ndarray, free: np.ndarray, k: int, nb: int, floor=-np.inf):
    """``(rows, pieces, least)``: the pieces that may hold one of a customer's k best, and a value that the k-th best reaches.

    ``a`` is customers x pieces of level weights, ``w`` the price weights, ``free`` how many products of a piece a customer does
    not own, ``floor`` what is known already of the k-th best. With fewer than k of them in all, ``least`` is the floor.
    """
    w = w[:, None]
    most, least = _bounds(a, w, z_lo, z_hi, nb)
    order = np.argsort(-least, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(free, order, axis=1), axis=1)
    row = np.arange(len(a))
    kth = least[row, order[row, np.argmax(held >= k, axis=1)]]
    # room for rounding, far below any difference that matters and far above an error of a few sums
    kth = np.where(held[:, -1] >= k, kth - 1e-9 * (a.max(axis=1) + np.abs(w[:, 0])), -np.inf)
    kth = np.maximum(kth, floor)
    rows, pieces = np.nonzero(most >= kth[:, None])
    return rows, pieces, kth


def _kth_of(row: np.ndarray, least: np.ndarray, free: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of each of n rows: the smallest value of the runs that hold its k best by smallest value; minus infinity with fewer than k products."""
    order = np.lexsort((-least, row))
    row = row[order]
    held = np.cumsum(free[order])
    start = np.searchsorted(row, np.arange(n))
    before = np.r_[0, held][start]
    at = np.flatnonzero(held - before[row] >= k)
    first = np.searchsorted(row[at], np.arange(n))
    found = np.flatnonzero(np.searchsorted(row[at], np.arange(n), "right") > first)
    kth = np.full(n, -np.inf)
    kth[found] = least[order[at[first[found]]]]
    return kth


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(which, place)``: for each i the places ``first[i] .. first[i] + count[i] - 1``."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + (first - (np.cumsum(count) - count))[which]


def _runs(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return new


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted value: its place in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _blocks_reached(number: int, of: int, left: pa.Table, right: pa.Table, blocks: list[str], k: int) -> pa.Table:
    """The blocks that may hold one of the k best of customers, and what a cell needs to know of them there.

    ``left`` has the owned products of block ``number`` of ``of`` blocks of customers, ``right`` the spans. The rows made are those of
    ``_best_of_cell``; owned products are named by their position, ``customer_id`` is given on rows of kind 0.
    """
    col = lambda t, c: t[c].to_numpy()
    ids, nb = left["customer_id"].combine_chunks(), len(blocks)
    found: list[tuple] = []
    if len(left) and len(right):
        coded = ids.dictionary_encode()
        by = pc.sort_indices(coded.dictionary).to_numpy()
        ids, who = coded.dictionary.take(pa.array(by)), np.argsort(by)[coded.indices.to_numpy()]
        by = np.lexsort((col(left, "pos"), who))
        who, pos, z, cnt = who[by], *(col(left, c)[by] for c in ("pos", "price_z", "cnt"))
        n = len(ids)
        weight = cnt / (np.sqrt(nb + z * z) if nb else 1.0)
        price_w = np.bincount(who, weight * z, n)
        square, levels = price_w * price_w, []
        for b in blocks:
            code = col(left, b)[by]
            known, at = np.unique(code, return_inverse=True)
            keys, at = np.unique(who * len(known) + at, return_inverse=True)
            sums, (row, level) = np.bincount(at, weight), np.divmod(keys, len(known))
            square += np.bincount(row, sums * sums, n)
            levels.append((row, known[level], sums))
        pnorm = np.sqrt(square)

        by = np.argsort(col(right, "first"))
        first, size, j, lo, hi = (col(right, c)[by] for c in ("first", "size", "j", "z_lo", "z_hi"))
        codes = [col(right, b)[by] for b in blocks]
        part = np.flatnonzero(_runs(j, *codes))
        spans = np.diff(np.r_[part, len(first)])
        part_of, part_size = np.repeat(np.arange(len(part)), spans), np.add.reduceat(size, part)
        same = (lo == hi) & ~_runs(lo, hi, *codes)  # the vector of the span before, and no other
        tie = np.cumsum(~same)
        span = np.searchsorted(first, pos, "right") - 1
        here = (span >= 0) & (pos < first[span] + size[span])
        own_row, own_pos, own_span = who[here], pos[here], span[here]
        level_of = [np.unique(c, return_inverse=True) for c in codes]
        in_block = []  # of each kind of level: the (block, level) that occur, by block
        for level, at in level_of:
            in_block.append(np.divmod(np.unique(j.astype(np.int64) * len(level) + at), len(level)))

        step = max(1, STRETCH // len(part))
        for c in range(0, n, step):
            d = min(n, c + step)
            a, own = np.zeros((d - c, len(part))), []
            for (level, at), (row, code, sums) in zip(level_of, levels):
                s = slice(*np.searchsorted(row, [c, d]))
                to, ok = _among(level, code[s])
                m = np.zeros((d - c, len(level)))
                m[row[s][ok] - c, to[ok]] = sums[s][ok]
                a += m[:, at[part]]
                own.append(m)
            s = slice(*np.searchsorted(own_row, [c, d]))
            orow, opos, ospan = own_row[s] - c, own_pos[s], own_span[s]
            free = part_size - np.bincount(orow * len(part) + part_of[ospan], minlength=a.size).reshape(a.shape)
            w = price_w[c:d]
            ends, okeys = (lo[part], hi[part + spans - 1]), orow * len(first) + ospan

            def in_spans(rows, parts):
                """The spans of (row, part) pairs: row, span, products not owned, largest value, and what a row's k-th best reaches."""
                which, f = _spread(part[parts], spans[parts])
                r = rows[which]
                at, ok = _among(r * len(first) + f, okeys)
                free = size[f] - np.bincount(at[ok], minlength=len(f))
                most, least = _bounds(a[rows, parts][which], w[r], lo[f], hi[f], nb)
                return r, f, free, most, _kth_of(r, least, free, k, d - c) - 1e-9 * (a.max(axis=1) + np.abs(w))

            # the parts of largest value first: their spans give a better bound than the ends of long parts do
            look = min(LOOK, len(part))
            likely = np.sort(np.argpartition(-_bounds(a, w[:, None], *ends, nb)[0], look - 1, axis=1)[:, :look], axis=1)
            floor = in_spans(np.repeat(np.arange(d - c), look), likely.ravel())[-1]
            rows, parts, kth = reached_pieces(a, w, *ends, free, k, nb, floor)
            r, f, free, most, least = in_spans(rows, parts)
            kth = np.maximum(kth, least)
            ok = most >= kth[r]
            r, f, free = r[ok], f[ok], free[ok]
            held = np.cumsum(free) - free  # before the span; less what was held before its ties began
            begin = np.maximum.accumulate(np.where(_runs(r, tie[f]), np.arange(len(f)), 0))
            ok = ~same[f] | (held - held[begin] < k)
            r, f = r[ok], f[ok]

            new = _runs(r, j[f])
            r, cell = r[new], j[f][new].astype(np.int64)
            none = np.zeros(len(r))
            found.append((cell, np.zeros(len(r)), c + r, none, price_w[c + r], pnorm[c + r], kth[r]))
            for i, (m, (block, level)) in enumerate(zip(own, in_block), 1):
                begin = np.searchsorted(block, cell)
                which, at = _spread(begin, np.searchsorted(block, cell, "right") - begin)
                x = m[r[which], level[at]]
                which, at, x = which[x != 0], at[x != 0], x[x != 0]
                zero = np.zeros(len(which))
                found.append((cell[which], zero + i, c + r[which], level_of[i - 1][0][level[at]], x, zero, zero))
            keys, okeys = r * (int(j.max()) + 1) + cell, orow * (int(j.max()) + 1) + j[ospan]
            ok = np.flatnonzero(_among(keys, okeys)[1])
            zero = np.zeros(len(ok))
            found.append((j[ospan[ok]], zero - 1, c + orow[ok], opos[ok], zero, zero, zero))
    flat = [np.concatenate(v) for v in zip(*found)] or [np.zeros(0)] * 7
    whole = lambda v: pa.array(v.astype(np.int32), pa.int32())
    row = flat[2].astype(np.int64)
    return pa.table({"j": whole(flat[0]), "kind": whole(flat[1]), "uid": whole(row * of + number), "num": whole(flat[3]),
                     **{c: pa.array(v, pa.float64()) for c, v in zip(("x", "y", "least"), flat[4:])},
                     "customer_id": ids.take(pa.array(row, pa.int64(), mask=flat[1] != 0))})


def _best_of_cell(left: pa.Table, right: pa.Table, blocks: list[str], k: int, constant: bool) -> pa.Table:
    """The k best un-owned products of each customer of a cell, by exact score, then id."""
    out: list[tuple] = []
    if len(left) and len(right):
        col = lambda t, c: t[c].to_numpy()
        iid, z, norm = (col(right, c) for c in ("product_id", "price_z", "norm"))
        codes = [col(right, b) for b in blocks]
        order = np.lexsort((iid, z, *codes[::-1]))
        iid, z, norm, codes = iid[order], z[order], norm[order], [c[order] for c in codes]
        n, place = len(iid), np.arange(len(iid))
        new = np.r_[True, np.zeros(n - 1, bool)]
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % PIECE == 0)
        size = np.diff(np.r_[start, n])
        piece_of = np.repeat(np.arange(len(start)), size)

        kind, who, num, x, y = (col(left, c) for c in ("kind", "uid", "num", "x", "y"))
        of = {j: np.flatnonzero(kind == j) for j in range(-1, len(blocks) + 1)}
        by = of[0][np.argsort(who[of[0]])]
        uid, price_w, pnorm = who[by], x[by], y[by]
        floor = col(left, "least")[by] if "least" in left.column_names else np.full(len(uid), -np.inf)
        rowed = {}  # of each kind but the customers: rows in order of the customer, what they name, weight
        for j in of:
            if j:
                row = np.searchsorted(uid, who[of[j]])
                by = np.argsort(row, kind="stable")
                rowed[j] = row[by], num[of[j]][by], x[of[j]][by]
        by_iid = np.argsort(iid)
        owned_row, owned_at = rowed[-1][0], by_iid[np.searchsorted(iid, rowed[-1][1], sorter=by_iid)]
        levels = [np.unique(c, return_inverse=True) for c in codes]

        step = max(1, STRETCH // n)
        for c in range(0, len(uid), step):
            d = min(len(uid), c + step)
            a = np.zeros((d - c, len(start)))
            for j, (level, at) in enumerate(levels, 1):
                row, code, weight = rowed[j]
                lo, hi = np.searchsorted(row, [c, d])
                own = np.zeros((d - c, len(level)))
                own[row[lo:hi] - c, np.searchsorted(level, code[lo:hi])] = weight[lo:hi]
                a += own[:, at[start]]
            lo, hi = np.searchsorted(owned_row, [c, d])
            held_row, held_at = owned_row[lo:hi] - c, owned_at[lo:hi]
            free = size - np.bincount(held_row * len(start) + piece_of[held_at], minlength=a.size).reshape(a.shape)
            rows, pieces, kth = reached_pieces(a, price_w[c:d], z[start], z[start + size - 1], free, k, len(blocks), floor[c:d])
            m = size[pieces]
            r, p = np.repeat(rows, m), np.repeat(start[pieces] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            number = np.repeat(a[rows, pieces], m) + price_w[c + r] * z[p]
            held = np.zeros((d - c) * n, bool)
            held[held_row * n + held_at] = True
            value = np.divide(number, norm[p], out=np.zeros(len(p)), where=norm[p] != 0)
            ok = ~held[r * n + p] & (value >= kth[r])
            r, p, number = r[ok], p[ok], number[ok]
            scale = norm[p] * pnorm[c + r]
            score = np.ones(len(p)) if constant else np.divide(number, scale, out=np.zeros(len(p)), where=scale != 0)
            order = np.lexsort((iid[p], -score, r))
            r, p, score = r[order], p[order], score[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((uid[c + r[best]], iid[p[best]], score[best]))
    parts = list(zip(*out)) or [[], [], []]
    flat = [np.concatenate(v) if len(v) else [] for v in parts]
    return pa.table({"customer_id": pa.array(flat[0], pa.int32()), "product_id": pa.array(flat[1], pa.int32()), "score": pa.array(flat[2], pa.float64())})


def _best_of_block(left: pa.Table, right: pa.Table, blocks: list[str], k: int, constant: bool) -> pa.Table:
    """``_best_of_cell`` for rows of ``_blocks_reached``, with the ids as the tables give them."""
    kind, num = left["kind"].to_numpy(), left["num"].to_numpy().copy()
    pos, iid, uid = right["pos"].to_numpy(), right["iid"].to_numpy(), left["uid"].to_numpy()
    by, own = np.argsort(pos), kind == -1
    num[own] = iid[by[np.searchsorted(pos, num[own], sorter=by)]]
    left_ = left.set_column(left.column_names.index("num"), "num", pa.array(num))
    best = _best_of_cell(left_, right.drop_columns("product_id").rename_columns([{"iid": "product_id"}.get(c, c) for c in right.column_names if c != "product_id"]), blocks, k, constant)
    head = np.flatnonzero(kind == 0)
    head = head[np.argsort(uid[head])]
    of = lambda ids, by, wanted: pa.array(by[np.searchsorted(ids, wanted.to_numpy(), sorter=by)] if len(wanted) else [], pa.int64())
    customer = pa.array(head[np.searchsorted(uid[head], best["customer_id"].to_numpy())], pa.int64())
    return pa.table({"customer_id": left["customer_id"].take(customer), "product_id": right["product_id"].take(of(iid, np.argsort(iid), best["product_id"])),
                     "score": best["score"]})


def content_topk(tables: RetailTables, k: int = TOP_K) -> DataFrame:
    """Top-K un-owned products per customer by cosine to the purchase-weighted content profile.

    Output ``(customer_id, rank, product_id, score)``; customers without
    purchases get no rows (the serving layer falls back to popular items).
    """
    vec, blocks, has_price = content_vectors(tables)
    if not blocks:  # a vector of the price alone is its sign
        vec = vec.withColumn("price_z", F.signum("price_z")).withColumn("norm", F.lit(1.0))
    # levels and products are numbered in their order, so that ties break alike
    vec = stored(vec, "vectors")
    for b in blocks:
        vec, _ = int_ids(vec, b, f"_{b}")
    vec = dense_positions(vec, [F.col("product_id").asc()], "iid")
    vec = vec.select("product_id", F.col("iid").cast("int").alias("iid"), *[F.col(f"_{b}").alias(b) for b in blocks], "price_z", "norm")
    vec = stored(dense_positions(vec, [F.col(c).asc() for c in (*blocks, "price_z", "iid")]).withColumn("pos", (F.col("pos") - 1).cast("int")), "numbered")
    n_items = vec.count()
    span = max(1, ITEM_BLOCK // PARTS, -(-n_items // (MOST_BLOCKS * PARTS)))
    vec = vec.withColumn("span", F.floor(F.col("pos") / span).cast("int"))
    j = F.floor(F.col("span") / min(PARTS, ITEM_BLOCK)).cast("int").alias("j")
    spans = stored(vec.groupBy("span", *blocks).agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("size"), F.min("price_z").alias("z_lo"),
                                                    F.max("price_z").alias("z_hi")).select(j, *blocks, "first", "size", "z_lo", "z_hi"), "spans")

    counts = stored(user_item_counts(tables.transactions), "counts")
    n_pairs, n_users, n_spans = *counts.select(F.count(F.lit(1)), F.approx_count_distinct("customer_id")).first(), spans.count()
    tasks = min(vec.sparkSession.sparkContext.defaultParallelism, -(-n_users // 512))
    ub, slices = max(1, tasks, -(-n_users // USER_BLOCK), -(-n_pairs // USER_PAIRS)), -(-n_spans // SLICE) or 1
    u = F.pmod(F.xxhash64("customer_id"), F.lit(ub)).cast("int").alias("u")
    every = lambda n, c: F.explode(F.sequence(F.lit(0), n - 1)).alias(c)
    owned = counts.join(vec, "product_id").select(u, every(F.lit(slices), "s"), "customer_id", "pos", *blocks, "price_z", "cnt")
    ends = spans.withColumn("s", F.pmod("j", F.lit(slices)).cast("int")).select(every(F.lit(ub), "u"), "s", *spans.columns)
    customer, product = (StructField(c, f.schema[c].dataType) for c, f in (("customer_id", counts), ("product_id", vec)))
    reached = StructType.fromDDL("j int, kind int, uid int, num int, x double, y double, least double").add(customer)
    left = stored(owned.groupBy("u", "s").cogroup(ends.groupBy("u", "s")).applyInArrow(
        lambda key, x, y: _blocks_reached(key[0].as_py(), ub, x, y, blocks, k), reached), "reached")

    # a block that many customers reach is several cells; there are at most MOST_BLOCKS blocks and one
    cells = F.broadcast(left.groupBy("j").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells")))
    left = left.join(cells, "j").withColumn("c", F.pmod(F.hash("uid"), F.col("cells")))
    right = vec.select(j, "pos", "iid", "product_id", *blocks, "price_z", "norm").join(cells, "j").select("*", every(F.col("cells"), "c")).drop("cells")
    constant = not blocks and not has_price
    found = left.drop("cells").groupBy("j", "c").cogroup(right.groupBy("j", "c")).applyInArrow(
        lambda x, y: _best_of_block(x, y, blocks, k, constant), StructType([customer, product]).add("score", "double"))
    w = Window.partitionBy("customer_id").orderBy(F.col("score").desc(), F.col("product_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "customer_id", F.col("rank").cast("int").alias("rank"), "product_id", rounded("score").alias("score"))
