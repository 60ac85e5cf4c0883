import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import ngram_join
from shelfspark.llm.ngram_join import Bands, NgramJoin, block_keys, drop_near_duplicates, link_documents, may_link, parity
from shelfspark.llm.text_hash import row_chunks, words


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(pairs, n, percent):
    sets = [shingles(t, n) for _, t in pairs]
    up = list(range(len(pairs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(pairs)]


def corpus(seed, originals=25, copies=12):
    """Families of copies at edit rates around the threshold, so that many pairs fall on either side of it."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("klmnop") + rnd.choice("xyz")
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(originals):
        base = [word() for _ in range(rnd.choice([2, 3, 4, 6, 9, 14, 25, 60, 150, 400]))]
        if rnd.random() < 0.4:
            base += common
        for _ in range(rnd.randrange(1, copies)):
            t = [word() if rnd.random() < rnd.choice([0, 0.01, 0.02, 0.04]) else w for w in base]
            if rnd.random() < 0.3:
                t = t[:-1]
            texts.append(" ".join(t))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_components_match_brute_force(docs, n, percent):
    p = corpus(n)
    got = [tuple(r) for r in link_documents(docs(p), n, percent).collect()]
    assert sorted(got) == sorted(brute(p, n, percent))


def test_edges(docs):
    p = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, "É é"), (9, "é é"),
         (None, "a  b"), (10, "x " * 30_000), (11, "x " * 29_000), (12, "a b c d e f g"), (12, "a b c d e f g"), (13, "z" * 100_000),
         (12, "other text of the same id")] + [(50 + i, "same hot text for a third of all rows") for i in range(40)]
    got = [tuple(r) for r in link_documents(docs(p), 3, 90).collect()]
    assert Counter(got) == Counter(brute(p, 3, 90))
    assert link_documents(docs([])).count() == 0


def test_links_across_tiles_and_components(docs, monkeypatch):
    """Chains whose members do not link with the smallest of a key: the second round must find them, over several tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    p = []
    for i in range(40):
        t = list(base)
        for k in range(i, i + 8):
            t[k % 120] = f"v{k}"
        p.append((i, " ".join(t)))
    rnd.shuffle(p)
    got = [tuple(r) for r in link_documents(docs(p), 1, 88).collect()]
    assert sorted(got) == sorted(brute(p, 1, 88))


def test_drop_keeps_one_of_each_component(docs):
    p = corpus(8) + [(5000, None), (5000, None), (5001, "same row twice here"), (5001, "same row twice here")]
    df = docs(p)
    kept = drop_near_duplicates(df, 3, 90)
    assert kept.columns == df.columns
    want = Counter(d for d, n, c in brute(p, 3, 90) if d == c or not n)
    want[5001] = 1
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_sketches_never_lose_a_linked_pair():
    rnd = np.random.default_rng(2)
    for percent in (50, 80, 90):
        bands = Bands(percent)
        for _ in range(400):
            n = int(rnd.integers(1, 300))
            s = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            t = np.unique(np.concatenate([s[rnd.random(len(s)) > 0.05], rnd.integers(0, 1 << 63, int(rnd.integers(0, 1 + n // 10)), dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                assert may_link(bands, len(s), len(t), parity(s, bands), parity(t, bands))
                assert np.intersect1d(block_keys(s, bands), block_keys(t, bands)).size


def test_words_over_blocks(monkeypatch):
    from shelfspark.llm import text_hash
    texts = ["a bb  ccc\n", "", "x" * 50, " lead", "é\x0bé", "a bb", "y " * 40]
    whole = [words(d, o) for _, _, d, o in row_chunks(pa.array(texts))][0]
    monkeypatch.setattr(text_hash, "BLOCK", 7)
    split = [words(d, o) for _, _, d, o in row_chunks(pa.array(texts))][0]
    assert (whole.hash == split.hash).all() and (whole.first == split.first).all()
    assert np.diff(whole.first).tolist() == [len(t.split()) for t in texts]
    assert (whole.hash[:2] == whole.hash[whole.first[5]:whole.first[6]]).all()
    one = [w.hash[w.first[0]:w.first[1]] for i, j, d, o in row_chunks(pa.array(texts), 1) for w in [words(d, o)]]
    assert (np.concatenate(one) == whole.hash).all()


def test_keys_with_the_same_holders_draw_the_same_pairs(spark):
    join = ngram_join.NgramJoin.__new__(ngram_join.NgramJoin)
    join.bands = ngram_join.Bands(80)
    held = spark.range(10).withColumnRenamed("id", "key").crossJoin(
        spark.range(40).selectExpr("id node", "id comp", "if(id < 30, 10L, 100L) n"))
    drawn = join._hubs(held).collect()
    # two hubs for the family, whatever number of keys it shares; no pair of sizes that cannot link
    assert 0 < len(drawn) <= ngram_join.HUBS * 39
    assert all((r.u < 30) == (r.v < 30) for r in drawn)


def test_first_each_set_meets_one_other(spark, monkeypatch):
    seen, sketched = [], ngram_join.NgramJoin._sketched
    monkeypatch.setattr(ngram_join.NgramJoin, "_sketched", lambda self, pairs, nodes: seen.append(pairs.count()) or sketched(self, pairs, nodes))
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:at], f"x{d}", *base[at + 1:]]) for d, at in enumerate(range(0, 40, 2))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(df, 3, 60).collect()}
    assert set(got.values()) == {0} and seen[0] < len(texts)
