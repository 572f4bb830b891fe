"""Shapes of the physical plans."""

import re

import pytest

from __spark_entry__ import queries
from tablelens.plans.groups import OrderedGroups
from tablelens.queries import QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_cross_joins_and_no_rows_in_one_task(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    for bad in ["Python", "Arrow", "NestedLoop", "CartesianProduct"]:
        assert bad not in plan, bad
    # One task gets aggregated rows only.
    lines = plan.splitlines()
    for above, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[above + 1] and "partial_" in lines[above + 1]


def test_literal_pattern_reaches_the_scan(spark):
    from tablelens import like_any

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    plan = plan_of(like_any(pages, "url", "example.com", case_sensitive=True))
    assert "StringContains(url,example.com)" in plan


def test_search_reads_only_what_it_needs(spark):
    plan = plan_of(queries()["grep_lines"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
    assert "Exchange" not in plan


def test_numbering_and_neighbours_share_one_shuffle(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    grouped = OrderedGroups(events, ["user_id"], ["ts"])
    grouped.neighbour("before", F.col("value")).running({"n": F.lit(1)}, totals={"n": "all"})
    assert plan_of(grouped.done()).count("Exchange") == 1


def test_runs_need_one_shuffle(spark):
    assert plan_of(queries()["runs"](spark, FOLDER)).count("Exchange") == 1


def test_first_match_ranks_before_the_shuffle(spark):
    plan = plan_of(queries()["first_match"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    from conftest import rows

    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = rows(queries()["run_lists"](spark, FOLDER))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(queries()["run_lists"](spark, FOLDER)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["graph_layout", "graph_layout_labels"])
def test_layouts_move_neither_edges_nor_paths_while_written(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and all("focus" in line and "ordinal" in line for line in moved)
