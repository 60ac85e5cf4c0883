import random
import re
from collections import Counter

import pytest

from shelfspark.llm import collocations as C


def counts(pairs, longest=5):
    f, n = Counter(), Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i:i + m])] += 1
    return f, n


def expected(pairs, least, top=2000):
    f, n = counts(pairs)
    cand = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    out = {}
    for (lang, phrase), a in cand.items():
        w = phrase.split(" ")
        if any(x[0] == lang and len(x[1].split(" ")) > len(w) and f" {phrase} " in f" {x[1]} " and b >= a for x, b in cand.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items()
                  for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def table(spark, pairs):
    rows = [(i, t, lang, "x", 1) for i, (lang, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int").repartition(3)


def corpus(seed=1, n=200):
    rnd = random.Random(seed)
    vocabulary = ["Of", "the", "and", "éa", "CAT", "dog", "sat", "on", "mat"] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        words = []
        while len(words) < rnd.randrange(5, 60):
            words += rnd.choice([["new", "York", "city", "hall", "steps"], ["by", "the", "way"], [rnd.choice(vocabulary)], [rnd.choice(vocabulary)]])
        text = "".join(w + rnd.choice([" ", " ", " ", "\t ", ", ", ".\n", "! "]) for w in words)
        out.append((rnd.choice(["en", "en", "de", None]), text))
    return out


@pytest.mark.parametrize("least", [5, 20])
def test_matches_a_loop(spark, least):
    pairs = corpus() + [("en", None), ("en", ""), (None, " .,\n"), ("fr", "x")] + [("en", "same line of words here")] * 40
    want = expected(pairs, least)
    assert sorted(map(tuple, C.collocations(table(spark, pairs), least=least).collect())) == want and len(want) > 10


def test_border_failures_are_expanded(spark):
    """A sample of almost nothing proposes almost nothing: all longer phrases come from the expansion pass."""
    pairs = corpus(2, 120)
    f, _ = counts(pairs)
    got, totals = C.frequent_phrases(table(spark, pairs), least=10, sample_of=1 << 40)
    assert {(r.lang, r.phrase): r.n for r in got.collect()} == {k: a for k, a in f.items() if a >= 10}
    assert {(r.lang, r.phrase) for r in got.collect() if r.m == 5}
    assert {r.lang: r.n for r in totals.collect()} == dict(counts(pairs)[1])


def test_top_is_per_language_and_ties_go_by_text(spark):
    pairs = [("en", "b c. a b. z y. é x.")] * 30 + [("de", "a b. c d")] * 30
    got = sorted(map(tuple, C.collocations(table(spark, pairs), top=2, least=10).collect()))
    assert got == expected(pairs, 10, top=2) and len(got) == 4


def test_long_texts_and_empty_tables(spark, monkeypatch):
    text = "a b c. " * 30_000 + "d " * 3_000
    assert sorted(map(tuple, C.collocations(table(spark, [("en", text)] * 2)).collect())) == expected([("en", text)] * 2, 100)
    assert C.collocations(table(spark, [])).count() == 0
    import numpy as np
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(C, "STRETCH", 1000)
    parts = list(C.stretches(data, np.array([0, 0, len(data)])))
    assert len(parts) > 100 and b"".join(p.tobytes() for p, _, _ in parts) == text.encode()
    seed = np.zeros(2, np.uint64)
    whole = [C.Grams(p, offs, seed[rows]) for p, offs, rows in parts]
    assert sum(len(g.hash) for g in whole) == len(text.split()) and {int(rows[r]) for (_, _, rows), g in zip(parts, whole) for r in g.row} == {1}


def test_bitmap_holds_its_keys(spark):
    import numpy as np
    keys = np.random.default_rng(0).integers(0, 1 << 64, 3000, dtype=np.uint64)
    frame = lambda a: spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "key long")
    held = C.Bits(C.bits_of(frame(keys[:500]), 500))
    assert held(keys[:500]).all() and held(keys[500:]).mean() < 0.1
    assert C._outside(frame(keys[:500]), held, spark).count() == 0 and C._outside(frame(keys), held, spark).count() > 2000


def test_texts_are_counted_over_flushes(spark, monkeypatch):
    pairs = corpus(4, 80)
    monkeypatch.setattr(C, "MOST_TEXTS", 5)
    assert sorted(map(tuple, C.collocations(table(spark, pairs), least=10).collect())) == expected(pairs, 10)
