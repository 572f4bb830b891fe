"""Every registered query against DuckDB on the given tables."""

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries
from tablelens.oracles import SQL
from tablelens.queries import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ducks():
    return {folder: duck(folder) for folder in (SMALL, LARGER)}


def check(spark, ducks, folder, name):
    got = queries()[name](spark, folder).toArrow()
    want = ducks[folder].sql(oracle_sql()[name]).to_arrow_table()
    assert want.num_rows > 0
    assert differences(got, want) == []


@pytest.mark.parametrize("name", oracle_sql())
def test_agrees_with_sql(spark, ducks, name):
    check(spark, ducks, LARGER, name)


@pytest.mark.parametrize(
    "name",
    [
        "search_outline",
        "search_report",
        "resolve_aliases",
        "alias_hops",
        "presence_flags",
        "first_match",
        "latest_match",
        "latest_match_after",
        "edge_ordinals",
        "two_hop_in",
        "two_hop_out",
        "two_hop_focus",
        "two_hop_stored",
        "graph_layout",
        "graph_layout_labels",
        "range_partition_table",
        "range_partition_prices",
        "discrete_boundaries",
        "partition_labels",
        "runs",
        "run_lists",
        "ordered_list",
        "collapse_list",
        "scoped_rules",
    ],
)
def test_agrees_with_sql_when_groups_are_cut(spark, ducks, hot, name):
    hot(3)
    check(spark, ducks, SMALL, name)


def test_every_query_has_sql_but_the_file_report():
    assert set(QUERIES) - set(SQL) == {"file_storage"}
    assert set(oracle_sql()) <= set(queries())


def test_file_report_covers_every_row(spark):
    found = queries()["file_storage"](spark, LARGER).collect()
    assert [(r.file_name, r.n_rows) for r in found] == [("orders.parquet", 15000)]
    assert found[0].avg_bytes == pytest.approx(found[0].file_bytes / 15000)


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "line", "line_text"]
