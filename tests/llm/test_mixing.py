import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import mixing
from shelfspark.llm.mixing import Model, _posteriors, extra, fit, fit_rates, learn, mix_rows, rate_rows


def corpus(n=300):
    rnd = random.Random(6)
    vocab = {"a": ["alpha", "apple", "arrow", "and"], "b": ["beta", "bread", "bolt", "but"], "c": ["coin", "cat", "cup", "can"]}
    out = []
    for i in range(n):
        domain = "aaaaaaabbc"[i % 10]
        w = [rnd.choice(vocab[domain]) if rnd.random() < 0.9 else rnd.choice(vocab["abc"[rnd.randrange(3)]]) for _ in range(rnd.randrange(5, 60))]
        out.append((i, " ".join(w), domain))
    return out


def test_classifier_on_rows_not_learnt_from():
    rows = corpus()
    model = fit([t for _, t, _ in rows[:200]], [d for _, _, d in rows[:200]])
    n, p = _posteriors(pa.array([t for _, t, _ in rows[200:]]), model)
    assert n.tolist() == [len(t.split()) for _, t, _ in rows[200:]]
    assert np.mean([model.domains[k] == d for k, (_, _, d) in zip(p.argmax(axis=1), rows[200:])]) >= 0.95
    assert np.allclose(p.sum(axis=1), 1)


def brute_rates(n, p, target, base, rounds=4000):
    """Nonnegative least squares in the same norm by plain coordinate-free projected gradient, run long."""
    inverse = np.linalg.inv((p * n[:, None]).T @ p + 1e-9 * max(1, n.sum()) * np.eye(p.shape[1]))
    e = np.zeros(len(n))
    for _ in range(rounds):
        e = np.maximum(0, e - p @ (inverse @ (((base + e) * n) @ p - target)))
    t = ((base + e) * n) @ p
    return (t - target) @ inverse @ (t - target), t


def test_rates_reach_targets(spark, docs):
    rows = corpus()
    df = docs([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "alpha"), (902, "coin " * 20_000), (5, rows[5][1])])
    model = learn(df, spark.createDataFrame([(i, d) for i, _, d in rows if i % 2] + [(3, None), (None, "a")], "doc_id long, domain string"))
    for weights in (None, {"a": 1.0, "b": 1.0, "c": 1.0}):
        got = fit_rates(df, model, weights=weights)
        assert all(a >= b - 1e-9 * abs(a) for a, b in zip(got.objective, got.objective[1:]))
        assert np.abs(got.reached - got.target).max() <= 0.01 * got.target.sum()
        told = rate_rows(df, got).collect()
        assert len(told) == len(rows) + 5 and all(r.rate >= 1 and r.copies >= 1 for r in told)
        n, p = _posteriors(pa.array([r[1] or "" for r in df.select("doc_id", "text").collect()]), model)
        value, _ = brute_rates(n.astype(float), p, got.target, 1.0)
        assert got.objective[-1] <= value + 1e-4 * got.objective[0]
        assert abs(sum(r.rate * r.n_tokens for r in told) - got.target.sum()) <= 0.01 * got.target.sum()
    kept = Counter(r.doc_id for r in mix_rows(df, got).collect())
    want = Counter()
    for r in told:
        want[r.doc_id] += r.copies
    assert kept == want and mix_rows(df, got).columns == df.columns


def test_base_zero_and_unreachable_target(docs):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 50)
    assert (extra(p, [np.array([1.0, 1.0, 1.0])]) == 0).all() and np.allclose(extra(p, [-np.ones(3)]), 1)
    model = Model(["x", "y"], np.zeros((mixing.BUCKETS + mixing.COUNTS + 1, 2)))
    got = fit_rates(docs([(i, "some words here") for i in range(20)]), model, weights={"x": 1.0}, base=0.0)
    assert np.isfinite(got.reached).all() and got.objective[-1] <= got.objective[0]


def test_no_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    df = docs([(1, "a b"), (2, "c")])
    model = learn(df, none)
    assert {(r.domain, r.copies) for r in rate_rows(df, fit_rates(df, model)).collect()} == {("all", 1)}
    empty = docs([])
    assert rate_rows(empty, fit_rates(empty, model)).count() == 0


def test_scarce_and_long_domains_are_learnt(spark, docs):
    """A domain that a plain sample misses, and one of long texts only, are domains like others."""
    rows = corpus()
    rows += [(1000 + i, "dune dusk dove " * (5 + i), "d") for i in range(3)] + [(2000 + i, "east edge " * 4000, "e") for i in range(3)]
    df = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, d) for i, _, d in rows] + [(9999, "no such row")], "doc_id long, domain string")
    model = learn(df, labels, sample=40)
    assert model.domains == ["a", "b", "c", "d", "e"]
    got = fit_rates(df, model)
    assert (got.target > 0).all()
    told = {r.doc_id: r.domain for r in rate_rows(df, got).collect()}
    assert [told[i] for i in (1000, 1001, 1002, 2000, 2001, 2002)] == [*"dddeee"]
    with pytest.raises(ValueError, match="unknown"):
        fit_rates(df, model, weights={"a": 1.0, "z": 1.0})
