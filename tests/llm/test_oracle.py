"""The queries of this package that SQL can state agree with DuckDB at sf0.001."""

import duckdb
import pytest

from shelfspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    order = sorted(range(len(df.columns)), key=lambda k: df.columns[k])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    back = sorted(range(len(cols)), key=lambda k: cols[k])
    assert sorted(repr([r[k] for k in order]) for r in df.collect()) == sorted(repr([r[k] for k in back]) for r in cur.fetchall())
