import datetime as dt
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions.widths import fixed_width, row_bytes
from pyspark.sql.types import DecimalType, StringType


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1, "é", Decimal("1.5"), None, b"abc", [1]), (2, None, None, None, b"", [2])],
        "a smallint, b string, c decimal(12,2), d date, e binary, f array<int>",
    )
    assert [tuple(r) for r in tl.column_profile(df).orderBy("ordinal").collect()] == [
        (1, "a", "smallint", 2, 0, False, 2),
        (2, "b", "string", 2, 1, True, 2),
        (3, "c", "decimal(12,2)", 2, 1, True, 9),
        (4, "d", "date", 2, 2, True, 4),
        (5, "e", "binary", 2, 0, False, 3),
        (6, "f", "array<int>", 2, 0, False, None),
    ]


def test_column_profile_of_empty_and_wide_tables(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(230)])
    found = tl.column_profile(wide).collect()
    assert sorted(r.ordinal for r in found) == list(range(1, 231))
    assert {(r.n_rows, r.n_null, r.max_bytes) for r in found} == {(3, 0, 8)}
    empty = tl.column_profile(wide.select("c0").where("c0 < 0")).collect()
    assert [tuple(r)[3:] for r in empty] == [(0, 0, False, 8)]


def test_widths():
    assert [fixed_width(DecimalType(p, 0)) for p in (9, 10, 19, 28, 29, 38)] == [5, 9, 9, 13, 17, 17]
    assert fixed_width(StringType()) is None


def test_row_bytes(spark):
    df = spark.createDataFrame([(1, "abc", dt.date(2020, 1, 1)), (2, None, None)], "a int, b string, c date")
    assert rows(df.select("a", row_bytes(df))) == [(1, 11), (2, 8)]
    assert rows(df.select("a", row_bytes(df, ["b"]))) == [(1, 3), (2, 0)]


def test_table_summary(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(1500)], "a int, p int")
    out = tl.table_summary(
        {"parted": (df, F.col("p")), "whole": (df, None), "none": (df.where("a < 0"), None)}
    )
    assert rows(out) == [
        ("none", 0, 0, None, "(empty)"),
        ("parted", 1500, 2, 12000, "1,500 rows in 2 partitions"),
        ("whole", 1500, 1, 12000, "1,500 rows"),
    ]


def test_sequence_profile(spark):
    def profile(values, kind="int"):
        df = spark.createDataFrame([(v,) for v in values], f"a {kind}")
        return tuple(tl.sequence_profile(df, "a").collect()[0])[1:]

    assert profile([10, 20, 30, 30]) == (10, 30, 3, 10, 18, 2**31 - 31)
    assert profile([1, 2, 4], "tinyint") == (1, 4, 3, None, 1, 123)
    assert profile([5, None]) == (5, 5, 1, None, 0, 2**31 - 6)
    assert profile([None]) == (None, None, 0, None, None, None)


def test_filtered_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    out = tl.filtered_counts(df, {"big": F.col("a") > 1, "unknown": F.col("a").isNull()})
    assert rows(out) == [(1, 1, 3)]


def test_presence_flags(spark, either):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, v string")
    other = spark.createDataFrame([(2,)] * 9 + [(None,)], "r int")
    out = tl.presence_flags(df, "k", {"a": (other, "r"), "b": (df.where("k = 1"), "k")})
    assert rows(out) == [(1, "x", False, True), (2, "y", True, False), (2, "z", True, False), (None, "n", False, False)]


def test_first_match(spark, either):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (1, 4, "b"), (2, 9, None), (2, 10, "q"), (None, 1, "n")], "k int, o int, v string")
    out = tl.first_match(left, right, {"a": "k"}, ["o", "v"])
    assert rows(out) == [(1, 4, "b"), (2, 9, None), (3, None, None), (None, None, None)]


def test_columns_with_dots_and_wide_sequences(spark):
    df = spark.createDataFrame([(-(2**63), "x"), (2**63 - 1, None)], "n long, `a.b` string")
    found = {r.col: r for r in tl.column_profile(df).collect()}
    assert found["a.b"].n_null == 1 and found["a.b"].max_bytes == 1
    wide = tl.sequence_profile(df, "n").first()
    assert wide.n_missing is None and wide.step is None and wide.headroom == 0
