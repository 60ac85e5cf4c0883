"""Result tables by key: replacement of single keys, lookups of single files, failed and repeated writes."""

import pytest
from shelfspark.sources.keyed import KeyedTable, get_fbt, get_personalized, get_popular

LISTS = "customer_id long, rank int, product_id long, score double"


def lists(spark, rows):
    return spark.createDataFrame(rows, LISTS)


def all_rows(table):
    df = table.read()
    return sorted(tuple(r) for r in df.select("customer_id", "rank", "product_id", "score").collect()) if df is not None else []


@pytest.fixture
def table(spark, tmp_path):
    def make(run="r1"):
        return KeyedTable(spark, str(tmp_path), "personalized", run, "customer_id", buckets=8)
    return make


def test_second_write_replaces_its_keys_only(spark, table):
    first = [(c, r, 10 * c + r, 1.0) for c in range(50) for r in (1, 2, 3)]
    table().upsert(lists(spark, first))
    assert all_rows(table()) == sorted(first)
    second = [(3, 1, 999, 2.0), (7, 1, 998, 2.0), (60, 1, 997, 2.0)]
    want = sorted([x for x in first if x[0] not in (3, 7)] + second)
    for _ in range(2):  # a retry changes nothing
        table().upsert(lists(spark, second))
        assert all_rows(table()) == want
    table("r2").upsert(lists(spark, second))
    assert all_rows(table()) == want and all_rows(table("r2")) == sorted(second)


def test_keys_are_deleted_and_emptied_buckets_stay_empty(spark, table):
    table().replace(lists(spark, [(c, 1, c, 0.0) for c in range(5)]))
    none = lists(spark, [])
    table().upsert(none, delete=spark.range(1, 5).withColumnRenamed("id", "customer_id"))
    assert all_rows(table()) == [(0, 1, 0, 0.0)]
    table().replace(lists(spark, [(9, 1, 9, 0.0)]))
    assert all_rows(table()) == [(9, 1, 9, 0.0)]
    table().replace(none)
    assert all_rows(table()) == []


def test_what_a_failed_write_left_is_not_read(spark, table, monkeypatch):
    t = table()
    t.upsert(lists(spark, [(1, 1, 5, 0.0), (2, 1, 6, 0.0)]))
    broken = table()
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        broken.upsert(spark.range(1).selectExpr("cast(1 as long) as customer_id", "1 as rank", "cast(77 as long) as product_id", "0.0D as score"))
    monkeypatch.undo()
    assert all_rows(table()) == [(1, 1, 5, 0.0), (2, 1, 6, 0.0)]


def test_lookup_reads_the_buckets_of_the_keys_only(spark, table):
    t = table()
    t.replace(lists(spark, [(c, r, c, 0.0) for c in range(200) for r in (1, 2)]))
    asked = spark.createDataFrame([(5,), (5,), (None,), (100_000,)], "customer_id long")
    got = t.lookup(asked)
    assert sorted((r.customer_id, r["rank"]) for r in got.collect()) == [(5, 1), (5, 2)]
    assert len(got.inputFiles()) <= 2 < len(t.read().inputFiles())
    assert table("none").lookup(asked) is None


def test_null_keys_are_not_written_and_strings_work(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "popular", "r1", "list_key", buckets=4)
    t.upsert(spark.createDataFrame([("overall", 1, 7, 1.0), ("overall", 2, 8, 0.5), ("segment:a", 1, 9, 1.0), (None, 1, 1, 1.0)],
                                   "list_key string, rank int, product_id long, score double"))
    assert t.read().count() == 3
    got = get_popular(spark.createDataFrame([("a",), ("b",), (None,)], "segment string"), t)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 9, "segment"), ("b", 1, 7, "overall_fallback"), ("b", 2, 8, "overall_fallback")]


def test_get_personalized_and_fbt(spark, tmp_path, table):
    t = table()
    t.upsert(lists(spark, [(1, r, 10 + r, 0.0) for r in range(1, 13)]))
    popular = KeyedTable(spark, str(tmp_path), "popular", "r1", "list_key", buckets=4)
    popular.upsert(spark.createDataFrame([("overall", 1, 7, 1.0)], "list_key string, rank int, product_id long, score double"))
    got = get_personalized(spark.createDataFrame([(1,), (2,)], "customer_id long"), t, popular)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, r, 10 + r, "personalized") for r in range(1, 11)] + [(2, 1, 7, "popularity_fallback")]
    fbt = KeyedTable(spark, str(tmp_path), "fbt", "r1", "item", buckets=4)
    assert get_fbt(spark.createDataFrame([(1,)], "product_id long"), fbt) is None
    fbt.upsert(spark.createDataFrame([(1, 1, 2, 0.1, "rule")], "item long, rank int, recommended long, score double, source string"))
    assert [tuple(r) for r in get_fbt(spark.createDataFrame([(1,), (5,)], "product_id long"), fbt).collect()] == [(1, 1, 2)]
    with pytest.raises(ValueError):
        get_personalized(spark.createDataFrame([(1,)], "customer_id long"), table("x"), KeyedTable(spark, str(tmp_path), "popular", "x", "list_key"))
