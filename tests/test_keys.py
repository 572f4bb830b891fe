import pytest
from conftest import rows

import tablelens as tl


def test_unique_sets(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, 3)], "a int, b int, c int")
    out = tl.unique_sets(df, [["b", "a"], ["a", "b"], ["a"], ["c"]])
    assert rows(out) == [("a", 3, 2, False), ("a;b", 3, 3, True), ("c", 3, 2, False)]
    assert rows(tl.unique_sets(df.where("a > 5"), [["a"]])) == [("a", 0, 0, True)]


def test_unique_sets_agree_with_distinct(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sets = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey"]]
    for r in tl.unique_sets(lines, sets).collect():
        distinct = lines.dropDuplicates(r.cols.split(";")).count()
        assert (r.n_distinct, r.is_unique) == (distinct, distinct == r.n_rows)


def test_fk_check(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, None), (9, 9), (9, 9)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 2)], "x int, y int")
    out = tl.fk_check(child, parent, {"a": "x", "b": "y"}, "fk")
    assert rows(out) == [("fk", 2, 2, 2, False)]
    one = tl.fk_check(child, parent, {"b": "y"}, "fk")
    assert rows(one) == [("fk", 2, 2, 2, False)]
    assert rows(tl.fk_check(child.where("a > 99"), parent, {"a": "x"}, "fk")) == [("fk", 0, 0, 0, True)]


@pytest.mark.parametrize(
    ("keys", "expected"),
    [
        ([1, 2, 3], (True, False, "¹−¹")),
        ([1, 1, 3], (False, False, "¹∞−¹")),
        ([1, 2, None], (True, True, "°−¹")),
        ([1, 1, None], (False, True, "°∞−¹")),
        ([], (True, False, "¹−¹")),
    ],
)
def test_cardinality(spark, keys, expected):
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    out = tl.relationship_cardinality([tl.Reference("c", "p", df, ["k"])])
    assert rows(out) == [("c", "p", *expected)]


def test_cardinality_of_composite_and_several(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1)], "a int, b int")
    both = tl.Reference("c", "p", df, ["a", "b"])
    # Not every column is NULL in any row, so the reference is not nullable.
    assert rows(tl.relationship_cardinality([both])) == [("c", "p", False, False, "¹∞−¹")]
    second = tl.Reference("c", "p", df, ["b"])
    unique = tl.Reference("c", "p", df.where("a = 2"), ["a"])
    out = tl.relationship_cardinality([both, second, unique])
    assert rows(out) == [("c", "p", True, True, "°−¹")]


def test_all_sets_come_from_one_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sets = [["l_orderkey"], ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]]
    for df in (tl.unique_sets(lines, sets), tl.sketched_sets(lines, sets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


def test_sketch_throws_out_only_what_is_far_from_unique(spark):
    df = spark.range(5000).selectExpr("id", "id % 4990 AS nearly", "id % 10 AS few", "IF(id > 3, NULL, id) AS nulls")
    sets = [["id"], ["nearly"], ["few"], ["nulls"], ["few", "id"]]
    exact = {r.cols: r for r in tl.unique_sets(df, sets).collect()}
    found = {r.cols: r for r in tl.unique_sets(df, sets, sketch=True).collect()}
    assert {c: (r.n_rows, r.is_unique) for c, r in found.items()} == {c: (r.n_rows, r.is_unique) for c, r in exact.items()}
    assert {c for c, r in found.items() if r.n_distinct is None} == {"few", "nulls"}
    assert exact["nulls"].n_distinct == 5 and found["nearly"].n_distinct == 4990
    assert rows(tl.unique_sets(df.select("few"), [["few"]], sketch=True)) == [("few", 5000, None, False)]
    assert rows(tl.unique_sets(df.where("id < 0"), [["few"]], sketch=True)) == [("few", 0, 0, True)]
