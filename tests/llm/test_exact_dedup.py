import hashlib
import random
import re
from collections import defaultdict

from shelfspark.llm.exact_dedup import drop_duplicates, duplicate_report


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            out.append((i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def pairs():
    rnd = random.Random(3)
    p = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(4)))) for i in range(60)]
    p += [(60, None), (61, ""), (62, " \t\n"), (63, "a\x0b b"), (63, "a b"), (None, "a b"), (None, "only null id"),
          (64, "x" * 200_000), (65, "x" * 200_000), (66, "é é"), (67, "é é"), (64, "x" * 200_000)]
    p += [(100 + i, "hot copy") for i in range(200)]
    return p


def test_report_matches_brute_force(docs):
    p = pairs()
    got = [tuple(r) for r in duplicate_report(docs(p)).collect()]
    assert sorted(got, key=str) == brute(p)


def test_saturated_filter_loses_nothing(docs):
    p = [(i, f"t{i % 900}") for i in range(1000)]
    got = [tuple(r) for r in duplicate_report(docs(p), max_bits=32768).collect()]
    assert sorted(got, key=str) == brute(p)


def test_drop_keeps_one_whole_row_of_each_text(docs):
    p = pairs()
    df = docs(p)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(x[0]) for x in brute(p) if x[3])


def test_empty_table(docs):
    assert duplicate_report(docs([])).count() == 0
    assert drop_duplicates(docs([])).count() == 0


def test_no_python_in_plan(docs):
    plan = duplicate_report(docs([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
