import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.periodic_runs import _runs_of_rows, collapse, find_runs, runs_of
from shelfspark.llm.queries import op11_periodic_runs, periodic_tails


def brute(w, least=12):
    """Every run, period by period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            whole = w[start:start + length]
            if length >= max(least, 2 * q) and not any(whole[d:] == whole[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        size, letters = rnd.randrange(70), rnd.choice([1, 2, 2, 3, 4, 30])
        w = [rnd.randrange(letters) for _ in range(size)]
        if size > 5 and rnd.random() < 0.5:
            a, p = rnd.randrange(size), rnd.randrange(1, 9)
            w = [w[i] if i < a else w[min(size - 1, a + (i - a) % p)] for i in range(size)]
        yield w


def as_numbers(w):
    seen = {}
    return [seen.setdefault(x, len(seen)) for x in w]


def test_automaton_finds_the_runs_of_a_loop():
    for w in sequences(1500):
        for least in (2, 12):
            assert runs_of(as_numbers(w), least) == brute(w, least), w


def test_runs_of_texts_with_words_left_out():
    for w in sequences(500, 2):
        text = "  ".join(f"w{x}" for x in w)
        (words, got), = _runs_of_rows(pa.array([text]), 12)
        assert got == brute(w)
        assert collapse(words, got) == [x for i, x in enumerate(words) if not any(s + q <= i < s + n for s, n, q in got)]


def test_fibonacci_word_and_long_period():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs_of(b) == brute(b)
    block = list(range(700))
    assert runs_of(block * 3 + block[:5]) == [(0, 2105, 700)]


def test_rows_and_edges(spark, docs):
    w = "a b c d e f".split()
    pairs = [(1, " ".join(w * 3)), (2, None), (3, ""), (4, "x"), (None, "y " * 12), (5, "y " * 11), (6, "u\tv\n" * 20_000), (6, "u\tv\n" * 20_000)]
    got = {}
    for r in find_runs(docs(pairs)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], bytes(r.kept).decode()))
    assert got == {1: [(18, [(0, 18, 6)], "a b c d e f")], 2: [(0, [], "")], 3: [(0, [], "")], 4: [(1, [], "x")], None: [(12, [(0, 12, 1)], "y")],
                   5: [(11, [], " ".join(["y"] * 11))], 6: [(40_000, [(0, 40_000, 2)], "u v")] * 2}
    assert find_runs(docs([])).count() == 0
    named = docs(pairs).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in find_runs(named).collect()} == {"d1", "d2", "d3", "d4", "d5", "d6", None}


def test_query_on_a_table_against_loops(spark, docs, tmp_path):
    rnd = random.Random(3)
    pairs = [(i, " ".join(rnd.choice(["of", "the", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(90)))) for i in range(300)] + [(300, None)]
    docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    def expected(i, text):
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
        return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))

    got = sorted(tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == [expected(i, t) for i, t in pairs]
    assert sum(r[1] > 0 for r in got) >= 20


@pytest.mark.parametrize("text", [None, "", "one", "one two three"])
def test_periodic_tails_of_short_texts(docs, text):
    (r,) = periodic_tails(docs([(i, text) for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:1])).collect()
    assert len(r.text.split()) == len((text or "").split())
