import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from shelfspark.llm import substring_dedup
from shelfspark.llm.substring_dedup import remove_repeats


def brute(pairs, window=20):
    """First start of each window by (id, start, order of texts as the operator breaks ties: not needed here)."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    big = 1 << 63
    first, out = {}, []
    for i, t in pairs:
        w = split(t)
        for k in range(len(w) - window + 1):
            key, at = tuple(w[k:k + window]), (big if i is None else i, k)
            first[key] = min(first.get(key, at), at)
    for i, t in pairs:
        w, gone = split(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (big if i is None else i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice(["", "x"])
    passages = [[word() for _ in range(rnd.randrange(15, 80))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p[a:a + rnd.randrange(1, 60)]
        out.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    out += [(n + i, " ".join(passages[0] + [word()])) for i in range(n // 2)]  # a third share one passage
    out += [(2 * n, "same " * 300), (2 * n + 1, "ab cd " * 120), (2 * n + 2, out[3][1]), (2 * n + 3, None), (2 * n + 4, " \n"),
            (2 * n + 5, "é " * 19), (2 * n + 6, "é " * 20), (None, " ".join(passages[1])), (2 * n + 7, "z" * 60_000)]
    rnd.shuffle(out)
    return out


def got(df, **k):
    return Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeats(df, **k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs, seed):
    p = corpus(seed)
    assert got(docs(p)) == Counter(brute(p))


def test_many_flushes_and_small_chunks(docs, monkeypatch):
    """Repeats that meet only in a bin, not in a flush."""
    p = corpus(3)
    df = docs(p)
    one = got(df)
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "ANCHOR_FLUSH", 500)
    rows = pa.table({"t": [t or "" for _, t in p], "rk": list(range(len(p))), "ord": [1 << 62 if i is None else i for i, _ in p]})
    from shelfspark.llm.substring_dedup import _cut_segments, _find_anchors, _repeated_anchors, _repeats_of_bin
    moved = pa.Table.from_batches(_find_anchors(20, 8, 3)(rows.to_batches()))
    places = {}
    for b in set(moved["bin"].to_pylist()):
        for r in _repeated_anchors(moved.filter(pa.compute.equal(moved["bin"], b))).to_pylist():
            places.setdefault(r["rk"], set()).add(r["pos"])
    rows = rows.append_column("pos", pa.array([sorted(places.get(k, ())) for k in range(len(p))], pa.list_(pa.int64())))
    moved = pa.Table.from_batches(_cut_segments(20, 8, 3)(rows.to_batches()))
    covered = {}
    for b in set(moved["bin"].to_pylist()):
        for r in _repeats_of_bin(20)(moved.filter(pa.compute.equal(moved["bin"], b))).to_pylist():
            covered.setdefault(r["rk"], set()).update(range(r["a"], r["b"] + 20))
    assert Counter((p[k][0], len(covered.get(k, ()))) for k in range(len(p))) == Counter((i, k) for i, _, k, _ in one.elements())


def test_other_windows(docs):
    p = corpus(4, 30)
    assert got(docs(p), window=12, prefix=5) == Counter(brute(p, 12))


def test_same_rows_and_empty_table(docs):
    text = " ".join(f"w{i}" for i in range(30))
    p = [(1, text), (1, text), (2, text)]
    assert got(docs(p)) == Counter(brute(p)) == Counter({(1, 30, 0, text.encode()): 2, (2, 30, 30, b""): 1})
    assert remove_repeats(docs([])).count() == 0


def told_by_bin(moved, bins):
    size = [0] * bins
    for b, d in zip(moved["bin"].to_pylist(), moved["done"].to_pylist(), strict=True):
        size[b] += len(d)
    return size


def test_what_a_flush_tells_is_spread_over_the_bins():
    """Copies of some texts: nearly everything is told in the flush, and no bin gets more than its part of it."""
    from shelfspark.llm.substring_dedup import _cut_segments, _find_anchors
    rnd = random.Random(5)
    texts = [" ".join(f"{rnd.randrange(10 ** 6)}" for _ in range(400)) for _ in range(20)]
    n = 2000
    rows = pa.table({"t": [texts[i % 20] for i in range(n)], "rk": [hash((i, 1)) for i in range(n)], "ord": list(range(n))})
    for bins in (4, 16):
        size = told_by_bin(pa.Table.from_batches(_find_anchors(20, 8, bins)(rows.to_batches())), bins)
        assert sum(size) > n * 30 * 16 and max(size) <= 2 * sum(size) / bins
    places = rows.append_column("pos", pa.array([list(range(400))] * n, pa.list_(pa.int64())))
    moved = pa.Table.from_batches(_cut_segments(20, 8, 4)(places.to_batches(max_chunksize=100)))
    size = told_by_bin(moved, 4)
    assert sum(size) > n * 16 and max(size) <= sum(size) / 2


def shared_line(n=300):
    """A line of 12 words in most texts, with other text around it: its prefix has a segment of every one of them."""
    rnd = random.Random(8)
    word = lambda: f"{rnd.randrange(10 ** 5)}"
    line = " ".join(f"line{k}" for k in range(12))
    out = [(i, " ".join([*(word() for _ in range(rnd.randrange(30))), line, *(word() for _ in range(rnd.randrange(30)))])) for i in range(n)]
    return out + [(n, out[3][1] + " x y z"), (n + 1, out[5][1]), (n + 1, out[5][1]), (None, "a b " + out[7][1])]


def test_a_common_prefix_is_lengthened(docs, monkeypatch):
    from shelfspark.llm.substring_dedup import _cut_segments, _find_anchors, _repeated_anchors
    p = shared_line() + corpus(6, 30)
    monkeypatch.setattr(substring_dedup, "BIN_BYTES", 2000)
    assert got(docs(p)) == Counter(brute(p))
    # flushes of a few kilobytes, so that next to nothing is told before the shuffle: no bin gets all of the line's segments
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 5000)
    p = shared_line(2000)
    rows = pa.table({"t": [t for _, t in p], "rk": list(range(len(p))), "ord": [1 << 62 if i is None else i for i, _ in p]})
    moved = pa.Table.from_batches(_find_anchors(20, 8, 1)(rows.to_batches()))
    found = _repeated_anchors(moved, 1 << 13).to_pylist()
    large = pa.array(sorted(r["pos"] % (1 << 64) for r in found if r["rk"] is None), pa.uint64()).to_numpy()
    assert 0 < len(large) < 20
    places = {}
    for r in found:
        places.setdefault(r["rk"], []).append(r["pos"])
    rows = rows.append_column("pos", pa.array([places.get(k, []) for k in range(len(p))], pa.list_(pa.int64())))
    most = []
    for keys in (None, large):
        moved, size = pa.Table.from_batches(_cut_segments(20, 8, 64, keys)(rows.to_batches())), Counter()
        for r in moved.to_pylist():
            size[r["bin"]] += sum(len(r[c]) for c in ("payload", "texts", "done", "whole"))
        most.append(max(size.values()) / sum(size.values()))
    assert most[0] > 0.2 and most[1] < 0.05, most
