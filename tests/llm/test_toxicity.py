import random

from shelfspark.llm import toxicity
from shelfspark.llm.toxicity import Words, fit, learn, offending, score, score_rows


def corpus(n=300, seed=4):
    rnd = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(60)], ["zork", "blarg", "quuxing"]
    out = []
    for i in range(n):
        sentences = [" ".join(rnd.choice(plain) for _ in range(6)) for _ in range(rnd.randrange(1, 8))]
        label = int(i % 3 == 0)
        if label:
            k = rnd.randrange(len(sentences))
            sentences[k] = sentences[k] + " " + rnd.choice(bad)
        out.append((i, ". ".join(sentences) + ".", label))
    return out


def test_fit_separates_and_locates():
    rows = corpus()
    model = Words(fit([t for _, t, _ in rows[:200]], [y for _, _, y in rows[:200]]))
    for _, t, y in rows[200:]:
        assert (score(t, model) >= 0.5) == bool(y)
        spans = offending(t, model)
        assert bool(spans) == bool(y)
        for s in spans:
            assert any(b in t[s["start"]:s["end"]] for b in ("zork", "blarg", "quuxing")) and "." not in t[s["start"]:s["end"]]


def test_noisy_or_of_sentences():
    model = Words({"": -2.0, "bad": 3.0})
    one, two = score("bad day.", model), score("bad day. Bad day!", model)
    assert abs(two - (1 - (1 - one) ** 2)) < 1e-12
    assert score("", model) == 0.0 and score("bad. day", Words({})) == 0.0


def test_rows_and_edges(spark, docs):
    rows = corpus()
    pairs = [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "zork w1."), (1002, "w1 " * 40_000 + "zork"), (1002, "w1")]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 200] + [(7, 0, None), (None, 0, 1), (5000, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    df = docs(pairs)
    model = learn(df, labels)
    got = score_rows(df, model, spans=True).collect()
    assert len(got) == len(pairs)
    by = {r.doc_id: r.score for r in got if r.doc_id != 1002}
    assert all((by[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert by[1000] == by[1001] == 0.0 and by[None] >= 0.5
    assert sorted(r.score >= 0.5 for r in got if r.doc_id == 1002) == [False, True]
    assert score_rows(docs([]), model).count() == 0
    assert learn(df, labels.where("false")) == {}
    assert learn(docs([]), labels) == {}
    assert {r.score for r in score_rows(df, {}).collect()} == {0.0}


def test_held_out_rows_are_not_learnt_from(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    import zlib
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
