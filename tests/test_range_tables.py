"""Boundaries as a table: every key with its own, in any number."""

import datetime as dt
import random

import pytest
from conftest import rows

import tablelens as tl
from tablelens.operators import ranges


def expected(values, bounds, right):
    def place(k, v):
        own = [b for key, b in bounds if key == k and b is not None]
        return 1 if v is None else 1 + sum((b <= v) if right else (b < v) for b in own)

    return sorted(((i, k, v, place(k, v)) for i, k, v in values), key=repr)


def made(seed):
    dice = random.Random(seed)
    bounds = [(k, dice.randrange(100)) for k in ("a", "b", None) for _ in range(dice.choice([3, 40, 90]))]
    bounds += [("a", None), ("only bounds", 5)]
    keys = ["a", "a", "a", "b", None, "no bounds"]
    values = [(i, dice.choice(keys), dice.choice([None, *range(-3, 104)])) for i in range(300)]
    return values, bounds


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("bucket", [1024, 4, 2])
def test_ranges_of_each_key(spark, either, monkeypatch, right, bucket):
    """One bucket per key, and several levels of small ones."""
    monkeypatch.setattr(ranges, "BUCKET_BOUNDS", bucket)
    values, bounds = made(bucket)
    df = spark.createDataFrame(values, "i int, k string, v int")
    table = spark.createDataFrame(bounds, "owner string, boundary int")
    got = tl.range_partition_table(df, "v", table, {"k": "owner"}, right=right)
    assert got.columns == ["i", "k", "v", "part_no"]
    assert rows(got) == expected(values, bounds, right)


def test_ranges_of_times_and_of_no_boundaries(spark):
    day = dt.datetime(2020, 1, 2)
    df = spark.createDataFrame([(1, 7, day)], "k int, j int, at timestamp_ntz")
    table = spark.createDataFrame([(1, 7, day), (1, 8, day), (1, 7, dt.datetime(2020, 1, 1))], "a int, b int, d timestamp_ntz")
    on = {"k": "a", "j": "b"}
    assert tl.range_partition_table(df, "at", table, on, "d").first().part_no == 3
    assert tl.range_partition_table(df, "at", table, on, "d", right=False).first().part_no == 2
    assert tl.range_partition_table(df, "at", table.limit(0), on, "d").first().part_no == 1
    assert tl.range_partition_table(df.limit(0), "at", table, on, "d").collect() == []


def test_small_boundaries_do_not_move_the_rows(spark):
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/part.parquet")
    sizes = parts.select("p_brand", "p_size").distinct()
    got = tl.range_partition_table(parts, "p_size", sizes, {"p_brand": "p_brand"}, "p_size")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "hashpartitioning" not in plan
