import random
import zlib

import numpy as np

from shelfspark.llm import quality
from shelfspark.llm.quality import _features_of, estimate_prior, features, fit, learn, minimise, risks, score_rows, sigmoid


def corpus(n, bad_share=0.3, seed=5):
    """(id, text, good): sentences, or junk of marks, repeats or capitals."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("da", "ko", "mi", "ne", "ru") for b in ("lan", "ver", "tos", "pim", "gru", "sel")]
    out = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 90))]
        bad = rnd.random() < bad_share
        if bad:
            words = rnd.choice([[w + rnd.choice(["###", "$$$"]) for w in words], [w for w in words for _ in (0, 1)], [w.upper() + "!!" for w in words]])
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_prior_and_scores_from_positives_and_unlabelled_alone():
    rows = corpus(1500)
    model = fit([t for _, t, y in rows[:500] if y], [t for _, t, _ in rows[500:1000]])
    assert abs(model.prior - 0.7) < 0.08
    s = sigmoid(_features_of([t for _, t, _ in rows[1000:]]) @ model.weights)
    y = np.array([y for *_, y in rows[1000:]])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97


def test_risk_and_its_gradient_against_plain_loops():
    rnd = np.random.default_rng(0)
    pos, unl, w, prior = rnd.normal(size=(40, 5)), rnd.normal(size=(60, 5)), rnd.normal(size=5), 0.4

    def loss(z):
        return np.log1p(np.exp(-z))

    a = prior * sum(loss(x @ w) for x in pos) / 40
    b = sum(loss(-(x @ w)) for x in unl) / 60 - prior * sum(loss(-(x @ w)) for x in pos) / 40
    assert np.allclose(risks(pos @ w, unl @ w, prior), (a, b))
    # one step from zero moves each weight against the sign of the gradient, found by differences
    grad = [sum(np.subtract(sum(risks(pos @ e, unl @ e, prior)), sum(risks(pos @ -e, unl @ -e, prior))).reshape(1)) / 2e-6 for e in np.eye(5) * 1e-6]
    assert (np.sign(minimise(pos, unl, prior, steps=1)) == -np.sign(grad)).all()


def test_second_part_of_the_risk_stays_about_zero():
    rnd = np.random.default_rng(1)
    pos, unl = rnd.normal(size=(30, 60)), rnd.normal(size=(40, 60))  # more features than a plain fit could bear
    w = minimise(pos, unl, 0.9)
    assert risks(pos @ w, unl @ w, 0.9)[1] > -0.1


def test_shares_of_a_text():
    x = features(np.frombuffer(b"", np.uint8), np.array([0, 0, 0]))
    assert x.shape[0] == 2 and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert 0.01 <= estimate_prior(np.ones((1, 2)), np.ones((1, 2))) <= 0.99


def test_rows_and_edges(spark, docs):
    rows = corpus(700)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    extra = [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "da### " * 40_000), (1002, rows[0][1])]
    df = docs([(i, t) for i, t, _ in rows] + extra)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 2 == 0] + [(3, None, 1), (None, 1, 0), (5000, 1, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = learn(df, labels.where(~quality.held_out()))
    assert learn(df, labels.where(~quality.held_out())).weights.tobytes() == model.weights.tobytes()
    got = [(r.doc_id, r.score) for r in score_rows(df, model).collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    held = [(i, y) for i, _, y in rows if fold(i)]
    assert sum((by[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert by[1000] == by[1001] and by[None] == by[0]
    assert sorted(s >= 0.5 for i, s in got if i == 1002) == [False, bool(rows[0][2])] or not rows[0][2]
    assert score_rows(docs([]), model).count() == 0
    none = learn(df, labels.where("false"))
    assert {r.score for r in score_rows(df, none).collect()} == {0.5}
    assert learn(docs([]), labels).prior == 0.5
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert learn(df, flipped.where(~quality.held_out())).weights.tobytes() == model.weights.tobytes()


def test_held_out_fold(spark):
    rows = spark.range(60).withColumnRenamed("id", "doc_id").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
