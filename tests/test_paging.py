"""Distributed ranks and keyset pages against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestry.operators import paging as pg
from attestry.operators import reports as rp
from attestry.operators import retrieval as rt
from attestry.operators import review as rv

ORDER = [("v", "desc"), ("name", "asc"), ("n", "asc")]


def rows_of(n):
    """One group holds two thirds of all rows; values repeat and are null now and then."""
    return [(None if k % 41 == 0 else "hot" if k % 3 else f"g{k % 5}", None if k % 7 == 0 else k % 13, None if k % 11 == 0 else f"x{k % 4}", k) for k in range(n)]


def in_order(rows):
    falling = lambda v: (v is None, -(v or 0))
    rising = lambda v: (v is not None, v or "")
    return sorted(rows, key=lambda r: (falling(r[1]), rising(r[2]), r[3]))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(500), "g string, v int, name string, n int").repartition(5)


def test_ranked_as_row_number(table):
    found = {r.n: r.position for r in pg.ranked(table, ["g"], ORDER).collect()}
    wanted = {}
    for group in {r[0] for r in rows_of(500)}:
        for k, r in enumerate(in_order(r for r in rows_of(500) if r[0] == group), 1):
            wanted[r[3]] = k
    assert found == wanted


def test_ranked_plan_keeps_groups_apart(spark, table):
    """The hot group lies in several partitions, and only sums go through a window."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = table.repartitionByRange(6, F.asc("g"), *pg.sort_columns(ORDER))
        parts = laid.where("g = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts >= 3
    plan = pg.ranked(table, ["g"], ORDER)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate" in window and plan.count("Window ") == 1


def test_ranked_empty_and_without_groups(spark, table):
    assert pg.ranked(table.limit(0), ["g"], ORDER).collect() == []
    every = sorted((r.position, r.n) for r in pg.ranked(table, [], ORDER).collect())
    assert [n for _, n in every] == [r[3] for r in in_order(rows_of(500))] and every[0][0] == 1 and every[-1][0] == 500


def test_repeated_rows_get_different_numbers(spark):
    same = spark.createDataFrame([("a", 1)] * 7 + [("b", None)], "g string, v int")
    assert sorted(r.position for r in pg.ranked(same, ["g"], [("v", "asc")]).where("g = 'a'").collect()) == list(range(1, 8))


def test_pages_follow_each_other(table):
    """Going on after the last row shows every row once, in order, over null keys too."""
    seen, after = [], None
    while True:
        page = pg.page_after(table, ORDER, after, 60).collect()
        if not page:
            break
        seen += [r.n for r in page]
        after = page[-1].asDict()
    assert seen == [r[3] for r in in_order(rows_of(500))]


@pytest.mark.parametrize("page", [1, 2, 7, 9, 40, 0, None])
def test_paginate_by_number(table, page):
    ends = pg.page_ends(table, ORDER, 60)
    found = rp.paginate(table, ORDER, page, 60, ends).orderBy("row_no").collect()
    held = min(max(page or 1, 1), 9)
    wanted = in_order(rows_of(500))[(held - 1) * 60 : held * 60]
    assert [r.n for r in found] == [r[3] for r in wanted]
    assert [r.row_no for r in found] == list(range((held - 1) * 60 + 1, (held - 1) * 60 + 1 + len(wanted)))
    assert {(r.page, r.pages) for r in found} == {(held, 9)}


def test_paginate_empty_and_whole_pages(spark, table):
    assert rp.paginate(table.limit(0), ORDER, 3, 10).collect() == []
    assert {r.pages for r in rp.paginate(table, ORDER, 5, 100).collect()} == {5}
    assert pg.numbered_page(table, ORDER, 6, 100).collect() == []


def test_key_reaches_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "rows"))
    page = pg.page_after(spark.read.parquet(str(tmp_path / "rows")), ORDER, {"v": 5, "name": "x1", "n": 44}, 20)
    plan = page._jdf.queryExecution().toString()
    assert "LessThan(v,5)" in plan.split("PushedFilters:")[1] and "Offset" not in plan and "offset" not in plan.lower().replace("offsets", "")


def test_list_documents_by_key_and_number(spark):
    day = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(f"d{k:02}", "kb", "completed", day + dt.timedelta(days=k % 4)) for k in range(23)], "doc_uid string, knowledge_base_id string, ingest_status string, updated_at timestamp")
    pages = [rp.list_documents(docs, page=p, page_size=5).collect() for p in range(1, 7)]
    wanted = sorted(((-(k % 4), f"d{k:02}") for k in range(23)))
    assert [r.doc_uid for p in pages for r in p] == [d for _, d in wanted] and {r.total for p in pages for r in p} == {23}
    assert rp.list_documents(docs, page_size=5, after=pages[1][-1].asDict()).collect() == pages[2]


def test_review_history_goes_on_after_a_page(spark):
    day = dt.datetime(2024, 1, 1)
    checks = spark.createDataFrame([(1, "a"), (2, "b")], "check_id int, knowledge_base_id string")
    claims = spark.createDataFrame([(1, 1, "t"), (2, 2, "t")], "claim_id int, check_id int, claim_text string")
    reviews = spark.createDataFrame([(k, 1 if k % 5 else 2, day + dt.timedelta(days=k // 3)) for k in range(40)], "review_id int, claim_id int, created_at timestamp")
    key = lambda df: sorted((r.knowledge_base_id, r.position, r.review_id, r.total) for r in df.collect())
    first = rv.review_history(reviews, claims, checks, 1, 6)
    second = rv.review_history(reviews, claims, checks, 2, 6)
    assert key(rv.review_history(reviews, claims, checks, page_size=6, after=first)) == key(second)
    third = key(rv.review_history(reviews, claims, checks, page_size=6, after=second))
    assert third == key(rv.review_history(reviews, claims, checks, 3, 6)) and {r[0] for r in third} == {"a"}


def test_query_history_per_document(spark):
    day = dt.datetime(2024, 1, 1)
    asked = spark.createDataFrame(
        [(k, "kb", f"d{k % 2}", f"q{k}", "", "[]", "{}", day + dt.timedelta(days=k)) for k in range(6)],
        "query_id int, knowledge_base_id string, doc_uid string, question string, answer string, evidence_json string, debug_json string, created_at timestamp",
    )
    rows = rt.query_history(asked, 2, "doc_uid").collect()
    assert sorted((r.doc_uid, r.position, r.query_id) for r in rows) == [("d0", 1, 4), ("d0", 2, 2), ("d1", 1, 5), ("d1", 2, 3)]
