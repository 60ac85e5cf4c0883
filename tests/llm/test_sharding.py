import random
import zlib
from collections import Counter, defaultdict

from shelfspark.llm.sharding import difference, shard_rows


def loads(sizes, shard, n):
    out = [0] * n
    for s, k in zip(sizes, shard, strict=True):
        out[k] += s
    return out


def naive(sizes, n):
    """Largest differencing on explicit lists, no heap and no trees."""
    parts = [(i, [(s, [i])] + [(0, [])] * (n - 1)) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (i, a), (j, b) = parts[:2]
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=lambda x: -x[0])
        parts = [(min(i, j), both), *parts[2:]]
    return [s for s, _ in parts[0][1]]


def test_difference_matches_naive_and_beats_greedy_order():
    rnd = random.Random(1)
    for n in (2, 3, 8):
        sizes = [rnd.randrange(1, 10_000) for _ in range(120)]
        got = loads(sizes, difference(sizes, n), n)
        assert sorted(got) == sorted(naive(sizes, n))
        assert max(got) - min(got) < 0.01 * sum(sizes) / n


def test_classic_example():
    assert sorted(loads([8, 7, 6, 5, 4], difference([8, 7, 6, 5, 4], 2), 2)) == [14, 16]
    assert difference([], 8) == []
    assert difference([5], 8) == [0]


def check(rows, pairs):
    assert len(rows) == len(pairs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rows(docs):
    rnd = random.Random(2)
    pairs = [(i, "w" * rnd.randrange(2000)) for i in range(400)] + [(None, None), (401, ""), (402, "é"), (402, "é")]
    rows = shard_rows(docs(pairs)).collect()
    check(rows, pairs)
    by = defaultdict(set)
    for r in rows:
        by[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(v) == 1 for v in by.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8


def test_one_group_with_a_third_of_all_bytes(docs):
    pairs = [(i, "same text of a hot group") for i in range(500)] + [(1000 + i, f"text {i} of its own!!") for i in range(1000)]
    rows = shard_rows(docs(pairs), items=64).collect()
    check(rows, pairs)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    hot = max(load.values())
    rest = sorted(load.values())[:-1]
    assert hot == 500 * 25 and rest[-1] - rest[0] < 0.2 * rest[0]


def test_empty(docs):
    assert shard_rows(docs([])).count() == 0
