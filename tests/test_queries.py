"""Registered queries against their SQL on the smallest tables, where these are present."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["parse_sections", "build_chunks", "clean_markdown", "expand_queries", "detect_changes", "set_default_kb", "review_queue", "match_rules"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from verification.compare import TABLES, norm

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    res = con.execute(oracle_sql()[name])
    head = [d[0] for d in res.description]
    assert sorted(head) == columns
    order = [head.index(c) for c in columns]
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())


def test_every_sql_belongs_to_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
