import numpy as np

from shelfspark.llm import ann
from shelfspark.llm.ann import centroids, may_hold, rotation, scan, search
from pyspark.sql import functions as F

KIND = "vec_id long, embedding array<float>, label int, list int, v string"


def brute(x, ids, queries, k):
    out = []
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(order)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "clash") for i, v in rows], KIND).repartition(3)


def test_scan_finds_most_scores_exactly_and_abandons():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32).astype(float)
    turn, q = rotation(64), np.arange(40)
    assert np.allclose(turn @ turn.T, np.eye(64))
    free, order, tally = np.full(40, np.inf), np.arange(3000), [0, 0, 0]
    qi, xi, near = scan(x[q], x, 10, free, q, order, tally)
    hits, kth = 0, np.zeros(40)
    for i in q:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        got, dist = xi[qi == i], near[qi == i]
        hits += len(set(np.lexsort((order, d))[1:11]) & set(got))
        assert np.array_equal(dist, d[got]) and (np.diff(dist) >= 0).all() and len(got) == 10 and i not in got
        kth[i] = dist[-1]
    assert hits >= 0.97 * 400
    assert tally[0] == 40 * 3000 and tally[1] > tally[0] / 2 and tally[2] < 0.8 * 64 * tally[0]
    bounded = [0, 0, 0]
    again = scan(x[q], x, 10, kth, q, order, bounded)  # the bound of an earlier scan tests the first batch too
    assert len(set(zip(qi, xi)) & set(zip(*again[:2]))) >= 0.97 * 400 and (again[2] <= kth[again[0]]).all()
    assert bounded[1] > tally[1] and bounded[2] < tally[2]


def test_lists_are_left_out_where_vectors_cluster():
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 32)) * 10
    far = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
    go = may_hold(far, np.full(20, 3.0), np.full(20, 0.5), np.full(20, 2.0), 0.4)
    assert np.array_equal(go, np.eye(20, dtype=bool))
    assert may_hold(far, np.full(20, np.inf), np.full(20, 0.5), np.full(20, 2.0), 0.4).all()


def test_search_with_ties_cells_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 50 * 8)
    monkeypatch.setattr(ann, "QUERIES", 2)
    monkeypatch.setattr(ann, "LIST", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[100:240] = x[100]  # a third of all vectors are one
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8), (1400, [float("inf")] + [1.0] * 7),
           (1500, [None] + [1.0] * 7), (1600, [1.0] * 3), (None, [1.0] * 8), (100, rows[100][1])]
    got = [tuple(r) for r in search(frame(spark, rows + bad), F.col("id") % 20 == 0, 10, lean=8.0).collect()]
    want = brute(x.astype(float), np.arange(400), range(0, 400, 20), 10)
    exact = {(q, r): (v, s) for q, r, v, s in want}
    assert len(got) == len(want)
    assert sum(exact[q, r] == (v, s) for q, r, v, s in got) >= 0.95 * len(want)
    assert [v for q, r, v, _ in sorted(got) if q == 120] == list(range(100, 110))


def test_few_candidates_and_empty(spark):
    rows = [(100 * i, [float(i + 1), 1.0]) for i in range(4)]
    got = [tuple(r) for r in search(frame(spark, rows), F.col("id") % 100 == 0).collect()]
    x = np.array([v for _, v in rows])
    assert sorted(got) == sorted(brute(x, np.arange(4) * 100, range(4), 10))
    named = spark.createDataFrame([(f"v{i}", v) for i, v in rows], "vec_id string, embedding array<float>")
    got = [tuple(r) for r in search(named, F.lit(True)).collect()]
    assert sorted(got) == sorted((f"v{q}", r, f"v{i}", s) for q, r, i, s in brute(x, np.arange(4) * 100, range(4), 10))
    assert search(frame(spark, rows[:1]), F.col("id") % 100 == 0).count() == 0
    assert search(frame(spark, []), F.col("id") % 100 == 0).count() == 0
    assert search(frame(spark, rows), F.col("id") < 0).count() == 0


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = sorted((r.vec_id, r.embedding) for r in df.collect())
    x, ids = np.array([v for _, v in data], float), np.array([i for i, _ in data])
    want = {(q, v) for q, _, v, _ in brute(x, ids, np.flatnonzero(ids % 100 == 0), 10)}
    got = {(r.query_id, r.vec_id) for r in search(df, F.col("id") % 100 == 0).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(centroids(x.copy(), 5)) == 5
