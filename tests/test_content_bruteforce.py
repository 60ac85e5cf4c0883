"""Content-based ranking against a brute-force dense computation on a random fixture
where most customers cover few categories and brands (so both candidate paths run)."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.operators import content as C
from shelfspark.sources.tables import RetailTables


def _brute(txn_rows, prod_rows, k):
    sold = sorted({r[2] for r in txn_rows})
    pmap = {p: (cat, br, pr) for p, cat, br, pr in prod_rows}
    cats = sorted({(pmap[p][0] if pmap[p][0] is not None else "__missing__") for p in sold})
    brs = sorted({(pmap[p][1] if pmap[p][1] is not None else "__missing__") for p in sold})
    prices = np.array([np.nan if pmap[p][2] is None else pmap[p][2] for p in sold], dtype=float)
    prices = np.where(np.isnan(prices), np.nanmean(prices), prices)
    z = (prices - prices.mean()) / (prices.std() + 1e-9)
    X = np.zeros((len(sold), len(cats) + len(brs) + 1))
    for i, p in enumerate(sold):
        X[i, cats.index(pmap[p][0] if pmap[p][0] is not None else "__missing__")] = 1
        X[i, len(cats) + brs.index(pmap[p][1] if pmap[p][1] is not None else "__missing__")] = 1
        X[i, -1] = z[i]
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    counts = {}
    for _, c, p, *_ in txn_rows:
        counts[(c, p)] = counts.get((c, p), 0) + 1
    out = {}
    for c in sorted({r[1] for r in txn_rows}):
        owned = {p: n for (cc, p), n in counts.items() if cc == c}
        prof = sum(n * Xn[sold.index(p)] for p, n in owned.items())
        prof = prof / np.linalg.norm(prof)
        scores = Xn @ prof
        cand = sorted(((-scores[i], p) for i, p in enumerate(sold) if p not in owned))[:k]
        out[c] = [(p, round(-s, 6)) for s, p in cand]
    return out


@pytest.mark.parametrize("items_in_a_block", [16, C.ITEM_BLOCK])
def test_content_matches_bruteforce(spark, monkeypatch, items_in_a_block):
    monkeypatch.setattr(C, "ITEM_BLOCK", items_in_a_block)
    rnd = random.Random(11)
    prods = []
    for p in range(60):
        cat = None if p % 17 == 0 else f"c{rnd.randint(0, 7)}"
        br = None if p % 13 == 0 else f"b{rnd.randint(0, 5)}"
        price = None if p % 11 == 0 else round(rnd.uniform(1, 100), 2)
        prods.append((p, cat, br, price))
    txn, tid = [], 0
    for c in range(25):
        for _ in range(rnd.randint(1, 4)):
            tid += 1
            txn.append((tid, c, rnd.randrange(60), 1.0, 5.0, dt.datetime(2025, 1, 1)))
    t = RetailTables(
        spark.createDataFrame(txn, "transaction_id long, customer_id long, product_id long, quantity double, "
                                   "price double, timestamp timestamp"),
        spark.createDataFrame([(c, "s") for c in range(25)], "customer_id long, segment string"),
        spark.createDataFrame(prods, "product_id long, category string, brand string, price double"))
    got = {}
    for r in C.content_topk(t, k=5).collect():
        got.setdefault(r["customer_id"], []).append((r["rank"], r["product_id"], r["score"]))
    want = _brute(txn, prods, 5)
    assert set(got) == set(want)
    for c, lst in want.items():
        g = [(p, s) for _, p, s in sorted(got[c])]
        assert [s for _, s in g] == [s for _, s in lst], c
        assert all(math.isclose(a, b, abs_tol=1e-6) for (_, a), (_, b) in zip(g, lst))
        assert [p for p, _ in g] == [p for p, _ in lst], c


def _cell(z, category, brand, profiles, owned):
    """The two tables of one cell; ``profiles``: per customer (W, category weights, brand weights)."""
    right = pa.table({"product_id": pa.array(range(len(z)), pa.int32()), "category": pa.array(category, pa.int32()), "brand": pa.array(brand, pa.int32()),
                      "price_z": pa.array(z, pa.float64()), "norm": np.sqrt(2 + np.square(z))})
    rows = [(0, c, 0, w, 1.0) for c, (w, _, _) in enumerate(profiles)]
    rows += [(j, c, level, x, 0.0) for c, p in enumerate(profiles) for j in (1, 2) for level, x in p[j].items()]
    rows += [(-1, c, i, 0.0, 0.0) for c, i in owned]
    return pa.table(dict(zip(("kind", "uid", "num", "x", "y"), map(list, zip(*rows))))), right


@pytest.mark.parametrize("prices", ["spread", "few", "constant"])
def test_a_cell_gives_the_exact_best(monkeypatch, prices):
    monkeypatch.setattr(C, "PIECE", 4)
    rnd = np.random.default_rng(3)
    n = 300
    z = {"spread": rnd.normal(size=n), "few": rnd.integers(-1, 2, n) * 1.0, "constant": np.zeros(n)}[prices]
    category, brand = rnd.integers(0, 6, n), rnd.integers(0, 5, n)
    profiles = [(float(rnd.normal()) * (c % 3 > 0), {int(v): 1.5 for v in rnd.integers(0, 6, 2)}, {int(rnd.integers(0, 5)): 0.7}) for c in range(40)]
    owned = [(c, int(i)) for c in range(39) for i in rnd.choice(n, 12, replace=False)] + [(39, i) for i in range(n - 3)]
    monkeypatch.setattr(C, "STRETCH", 7 * n)
    got = C._best_of_cell(*_cell(z, category, brand, profiles, owned), ["category", "brand"], 5, False).to_pylist()
    for c, (w, cats, brands) in enumerate(profiles):
        score = [(cats.get(int(category[i]), 0.0) + brands.get(int(brand[i]), 0.0) + w * z[i]) / np.sqrt(2 + z[i] ** 2) for i in range(n)]
        want = sorted((-score[i], i) for i in range(n) if (c, i) not in set(owned))[:5]
        assert [r["product_id"] for r in got if r["customer_id"] == c] == [i for _, i in want]


def test_bounds_skip_most_pieces():
    rnd = np.random.default_rng(5)
    groups, pieces = 60, 10
    lo = np.tile(np.linspace(-2, 1.6, pieces), groups)
    own = (rnd.random((200, groups)) < 0.05) * rnd.uniform(0.5, 2, (200, groups))
    own[:, 0] += 0.5
    a, free = np.repeat(own, pieces, axis=1), np.full((200, groups * pieces), 64)
    rows, _, least = C.reached_pieces(a, rnd.normal(size=200), lo, lo + 0.4, free, 10, 2)
    assert np.isfinite(least).all() and len(rows) < 0.1 * a.size
    same = np.zeros_like(lo)  # constant prices: only the customer's best group is left
    rows, at, _ = C.reached_pieces(a, np.zeros(200), same, same, free, 10, 2)
    assert len(rows) == 200 * pieces and (own[rows, at // pieces] == own.max(axis=1)[rows]).all()


@pytest.mark.parametrize("prices", ["spread", "few", "constant"])
@pytest.mark.parametrize("owns_most", [False, True])
def test_customers_go_to_the_few_blocks_that_matter(prices, owns_most):
    """However many blocks the products make, a customer is sent to those that may hold one of the best, with all that the exact best need."""
    rnd = np.random.default_rng(8)
    n, k, span, in_block, of, number = 6000, 5, 4, 16, 3, 1
    z = {"spread": rnd.normal(size=n), "few": rnd.integers(-1, 2, n) * 1.0, "constant": np.zeros(n)}[prices]
    category, brand, iid = rnd.integers(0, 4, n), rnd.integers(0, 5, n), rnd.permutation(n)
    by = np.lexsort((iid, z, brand, category))
    z, category, brand, iid = z[by], category[by], brand[by], iid[by]
    ints = lambda v: pa.array(np.asarray(v).astype(np.int32), pa.int32())
    cut = np.arange(n) // span
    first = np.flatnonzero(np.r_[True, (np.diff(cut) != 0) | (np.diff(category) != 0) | (np.diff(brand) != 0)])
    size = np.diff(np.r_[first, n])
    ends = pa.table({"j": ints(cut[first] // in_block), "category": ints(category[first]), "brand": ints(brand[first]), "first": ints(first),
                     "size": ints(size), "z_lo": z[first], "z_hi": z[first + size - 1]})
    names = [f"c{i:02d}" for i in range(30)]
    own = {c: rnd.choice(n, 12, replace=False) for c in names}
    if owns_most:
        own["c07"] = rnd.choice(n, n - 3, replace=False)
    pairs = [(c, int(p), int(rnd.integers(1, 4))) for c in names for p in own[c]]
    who, pos, cnt = (np.array(v) for v in zip(*pairs))
    owned = pa.table({"customer_id": pa.chunked_array([pa.array(who.tolist(), pa.string())]), "pos": ints(pos), "category": ints(category[pos]),
                      "brand": ints(brand[pos]), "price_z": z[pos], "cnt": pa.array(cnt.astype(np.int64))})
    blocks = ["category", "brand"]
    sent = C._blocks_reached(number, of, owned, ends, blocks, k)
    heads = sent.filter(pa.array(sent["kind"].to_numpy() == 0))
    n_blocks = int(cut[-1]) // in_block + 1
    assert n_blocks > 90 and set(heads["uid"].to_pylist()) == {i * of + number for i in range(len(names))}
    often = np.array([r["customer_id"] for r in heads.to_pylist()])
    assert sum(often != "c07") <= 4 * (len(names) - 1)
    products = pa.table({"pos": ints(np.arange(n)), "iid": ints(iid), "product_id": pa.array([f"p{i:04d}" for i in iid]), "category": ints(category),
                         "brand": ints(brand), "price_z": z, "norm": np.sqrt(2 + z * z)})
    got = []
    for j in sorted(set(heads["j"].to_pylist())):
        here = products.filter(pa.array(cut // in_block == j))
        got += C._best_of_block(sent.filter(pa.array(sent["j"].to_numpy() == j)), here, blocks, k, False).to_pylist()
    x = np.zeros((n, 10))
    x[np.arange(n), category] = 1
    x[np.arange(n), 4 + brand] = 1
    x[:, 9] = z
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for c in names:
        mine = [(p, w) for d, p, w in pairs if d == c]
        profile = sum(w * x[p] for p, w in mine)
        score = x @ profile / np.linalg.norm(profile)
        free = np.setdiff1d(np.arange(n), [p for p, _ in mine])
        want = sorted((-round(score[p], 9), f"p{iid[p]:04d}") for p in free)[:k]
        best = sorted((-round(r["score"], 9), r["product_id"]) for r in got if r["customer_id"] == c)[:k]
        assert best == want, c


def test_content_without_levels_matches_bruteforce(spark, monkeypatch):
    """A price alone: the cosine is the product of two signs, ties go to the smaller id, and no customer needs every product."""
    monkeypatch.setattr(C, "ITEM_BLOCK", 4)
    prods = [(p, float(p % 7)) for p in range(40)]
    txn = [(t, t % 6, (t * 11) % 40, 1.0, 5.0, dt.datetime(2025, 1, 1)) for t in range(80)]
    t = RetailTables(
        spark.createDataFrame(txn, "transaction_id long, customer_id long, product_id long, quantity double, price double, timestamp timestamp"),
        spark.createDataFrame([(c, "s") for c in range(6)], "customer_id long, segment string"),
        spark.createDataFrame(prods, "product_id long, price double"))
    sold = sorted({r[2] for r in txn})
    price = np.array([float(p % 7) for p in sold])
    sign = dict(zip(sold, np.sign((price - price.mean()) / (price.std() + 1e-9))))
    got = {}
    for r in sorted(C.content_topk(t, k=4).collect(), key=lambda r: (r["customer_id"], r["rank"])):
        got.setdefault(r["customer_id"], []).append((r["product_id"], r["score"]))
    for c in range(6):
        bought = [r[2] for r in txn if r[1] == c]
        side = np.sign(sum(sign[p] for p in bought))
        want = sorted((-side * sign[p], p) for p in sold if p not in bought)[:4]
        assert got[c] == [(p, -s) for s, p in want]
