import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

import tablelens as tl


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("count", [1, 3, 32, 33, 500])
def test_range_partition(spark, right, count):
    bounds = [3 * i for i in range(count)]
    values = [None, -5, *range(0, 3 * count, max(1, count // 7)), 3 * count + 9]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    expected = [
        (v, 1 if v is None else 1 + sum((b <= v) if right else (b < v) for b in bounds)) for v in values
    ]
    out = tl.range_partition(df, "v", bounds[::-1], right)
    assert rows(out) == sorted(expected, key=repr)


def test_range_partition_of_times(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 00:00:00' AS t, timestamp_ntz'2020-01-01 00:00:00' AS n, date'2020-01-01' AS d")
    at = dt.datetime(2020, 1, 1)
    for column, bound in [("t", at), ("n", at), ("d", at.date())]:
        assert tl.range_partition(df, column, [bound]).first().part_no == 2
        assert tl.range_partition(df, column, [bound], right=False).first().part_no == 1


def test_discrete_boundaries(spark, either):
    days = [dt.date(2020, 2, 28), dt.date(2020, 2, 29), dt.date(2020, 3, 1), dt.date(2020, 3, 3)]
    numbers = [1, 2, 3, 5, 6]
    df = spark.createDataFrame([("k", v) for v in numbers] + [("one", 1)], "k string, boundary int")
    assert rows(tl.discrete_boundaries(df, "k")) == [
        ("k", 1, False),
        ("k", 2, True),
        ("k", 3, False),
        ("k", 5, False),
        ("k", 6, True),
        ("one", 1, False),
    ]
    df = spark.createDataFrame([("k", d) for d in days], "k string, boundary date")
    assert [r[2] for r in rows(tl.discrete_boundaries(df, "k"))] == [False, True, False, False]
    text = spark.createDataFrame([("k", "1"), ("k", "2")], "k string, boundary string")
    assert [r[2] for r in rows(tl.discrete_boundaries(text, "k"))] == [False, False]


def test_discrete_boundaries_of_booleans(spark):
    df = spark.createDataFrame([("k", False), ("k", True)], "k string, boundary boolean")
    assert rows(tl.discrete_boundaries(df, "k")) == [("k", False, False), ("k", True, True)]


def test_discrete_boundaries_at_the_end_of_the_type(spark):
    df = spark.createDataFrame([("k", 2**63 - 2), ("k", 2**63 - 1)], "k string, boundary long")
    assert [r[2] for r in rows(tl.discrete_boundaries(df, "k"))] == [False, True]


@pytest.mark.parametrize(
    ("right", "labels"),
    [
        (True, ["c < 1", "c=1", "2 <= c < 4", "4 <= c"]),
        (False, ["c <= 1", "c=2", "2 < c <= 4", "4 < c"]),
    ],
)
def test_labels(spark, right, labels):
    # 2 is no discrete boundary before 4, but is when it is the last.
    df = spark.createDataFrame([("k", 1, 1), ("k", 2, 2)], "k string, n int, b int")
    wider = spark.createDataFrame([("k", 1, 2), ("k", 2, 4)], "k string, n int, b int")
    short = tl.partition_labels(df, "k", "n", "b", "c", right)
    assert [r[2] for r in sorted(short.collect())][:2] == labels[:2]
    assert [r[2] for r in sorted(tl.partition_labels(wider, "k", "n", "b", "c", right).collect())][1:] == labels[2:]


def test_labels_of_times(spark):
    df = spark.sql("SELECT 'k' AS k, 1 AS n, timestamp_ntz'2020-01-01 00:00:00' AS b UNION ALL SELECT 'k', 2, timestamp_ntz'2020-01-01 10:30:00'")
    assert [r[2] for r in sorted(tl.partition_labels(df, "k", "n", "b", "t").collect())] == [
        "t < 2020-01-01",
        "2020-01-01 <= t < 2020-01-01 10:30:00",
        "2020-01-01 10:30:00 <= t",
    ]


def test_partition_storage(spark):
    df = spark.createDataFrame([(1, "ab"), (1, ""), (2, "cdef"), (3, None)], "p int, t string")
    assert rows(tl.partition_storage(df, "p")) == [
        (1, 2, 2, 1.0, pytest.approx(100 / 3)),
        (2, 1, 4, 4.0, pytest.approx(200 / 3)),
        (3, 1, 0, 0.0, 0.0),
    ]
    nothing = tl.partition_storage(df.where("p = 3"), "p")
    assert rows(nothing) == [(3, 1, 0, 0.0, None)]
    assert rows(tl.partition_storage(df.where("p > 3"), "p")) == []


def test_storage_of_empty_ranges(spark):
    df = tl.range_partition(spark.createDataFrame([(5,), (25,)], "v int"), "v", [10, 20])
    assert rows(tl.partition_storage(df, "part_no", ranges=3)) == [
        (1, 1, 4, 4.0, 50.0),
        (2, 0, 0, None, 0.0),
        (3, 1, 4, 4.0, 50.0),
    ]
    nothing = tl.partition_storage(df.where("v > 30"), "part_no", ranges=2)
    assert rows(nothing) == [(1, 0, 0, None, None), (2, 0, 0, None, None)]


def test_file_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(4).write.parquet(path)
    found = tl.file_storage(spark.read.parquet(path)).collect()
    assert len({r.file_name for r in found}) == 4 and sum(r.n_rows for r in found) == 100
    for r in found:
        assert r.file_bytes == (tmp_path / "t" / r.file_name).stat().st_size


def test_state_pivot(spark):
    df = spark.createDataFrame([(1, "o", 5), (1, "o", 6), (1, "x", 7), (2, "c", None)], "k int, s string, v int")
    out = tl.state_pivot(df, ["k"], "s", {"o": "open", "c": "closed"}, {"n": (F.count, F.lit(1)), "v": (F.sum, F.col("v"))})
    assert out.columns == ["k", "n_open", "n_closed", "v_open", "v_closed"]
    assert rows(out) == [(1, 2, 0, 11, None), (2, 0, 1, None, None)]


def test_bytes_of_nested_columns(spark):
    df = spark.createDataFrame(
        [(1, (2, "ab"), ["x", None, "yz"], {"k": [1, 2]}, [1, 2, 3]), (1, None, None, None, None)],
        "p int, s struct<a: int, b: string>, t array<string>, m map<string, array<bigint>>, f array<int>",
    )
    # 4 + 2, 1 + 0 + 2, 1 + 16 and 12; nothing in a NULL.
    assert rows(tl.partition_storage(df, "p").select("n_rows", "bytes")) == [(2, 6 + 3 + 17 + 12)]


def test_blocks_of_files(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(4000).selectExpr("id", "id % 3 AS k", "sha2(string(id), 256) AS s").repartition(4).write.parquet(place)
    got = {r.k: r for r in tl.block_storage(spark.read.parquet(place), "k").collect()}
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert {k: (r.n_rows, r.n_files) for k, r in got.items()} == {0: (1334, 4), 1: (1333, 4), 2: (1333, 4), None: (4000, 4)}
    assert got[None].stored_bytes == pytest.approx(size) and got[None].stored_pct == pytest.approx(100)
    assert sum(got[k].stored_bytes for k in (0, 1, 2)) == pytest.approx(size)


def test_sequence_of_decimals_without_places(spark):
    df = spark.sql("SELECT cast(col1 AS decimal(5,0)) AS d, cast(col1 AS decimal(30,0)) AS w FROM VALUES (1), (3), (7)")
    assert tl.sequence_profile(df, "d").first().headroom == 99_992
    assert tl.sequence_profile(df, "w").first().headroom == 2**63 - 8
