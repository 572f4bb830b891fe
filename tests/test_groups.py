"""Windows and joins with and without cut groups, against plain Python."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablelens.plans import groups
from tablelens.plans.groups import OrderedGroups, hot_groups
from tablelens.plans.joins import balanced_join


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows under one key, some under NULL, the rest spread."""
    rng = random.Random(5)
    keys = [rng.choice(["hot", "hot", None, "a", "b", f"k{i % 17}", f"k{i % 5}"]) for i in range(900)]
    values = list(range(900))
    rng.shuffle(values)
    return [(k, v % 13 or None, v) for k, v in zip(keys, values, strict=True)]


@pytest.fixture(params=[2, 7, 50, 1_000_000])
def sizes(request, hot):
    hot(request.param)
    return request.param


def by_key(data):
    groups = defaultdict(list)
    for key, a, b in data:
        groups[key].append((a, b))
    return {k: sorted(g, key=lambda r: (r[0] or 0, r[1])) for k, g in groups.items()}


def test_running_sums_and_totals(spark, skewed, sizes):
    df = spark.createDataFrame(skewed, "k string, a int, b int")
    grouped = OrderedGroups(df, ["k"], ["a", "b"])
    assert grouped.is_split == (sizes < 1_000_000)
    out = grouped.running({"n": F.lit(1), "s": F.col("b")}, totals={"n": "all"}).done()
    expected = [
        (k, a, b, i + 1, sum(y for _, y in g[: i + 1]), len(g))
        for k, g in by_key(skewed).items()
        for i, (a, b) in enumerate(g)
    ]
    assert rows(out.select("k", "a", "b", "n", "s", "all")) == sorted(expected, key=repr)


@pytest.mark.parametrize("before", [True, False])
def test_neighbours(spark, skewed, sizes, before):
    df = spark.createDataFrame(skewed, "k string, a int, b int")
    nulled = F.when(F.col("b") % 10 != 0, F.col("b"))
    grouped = OrderedGroups(df, ["k"], ["a", "b"]).neighbour("near", nulled, before)
    out = grouped.done().select("k", "b", F.col("near").isNull(), F.col("near.v"))
    expected = []
    for k, g in by_key(skewed).items():
        for i, (_, b) in enumerate(g):
            at = i - 1 if before else i + 1
            near = g[at][1] if 0 <= at < len(g) else None
            expected.append((k, b, near is None, near if near is not None and near % 10 else None))
    assert rows(out) == sorted(expected, key=repr)


def test_equal_order_values_stay_together(spark, hot):
    hot(3)
    df = spark.createDataFrame([("x", 1)] * 40, "k string, a int")
    out = OrderedGroups(df, ["k"], ["a"]).running({"n": F.lit(1)}, totals={"n": "all"}).done()
    assert sorted(r.n for r in out.collect()) == list(range(1, 41))
    assert {r["all"] for r in out.collect()} == {40}


def test_hot_groups_are_split_evenly(spark, hot):
    hot(100)
    df = spark.range(10_000).select(F.lit("x").alias("k"), F.col("id").alias("a"))
    grouped = OrderedGroups(df, ["k"], ["a"])
    sizes = [r["count"] for r in grouped.rows.groupBy("_part").count().collect()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 10_000
    assert ranges / 2 < len(sizes) <= ranges and max(sizes) < 2 * 10_000 / ranges


def test_very_many_hot_groups(spark, hot):
    """Nothing is left whole or unjoined, however many groups are hot."""
    hot(3)
    df = spark.range(60_000).select((F.col("id") % 12_000).alias("k"), F.col("id").alias("a"))
    grouped = OrderedGroups(df, ["k"], ["a"]).running({"n": F.lit(1)}, totals={"n": "all"})
    assert grouped.is_split
    right = grouped.done().select((F.floor(F.col("a") / 12_000) + 1 == F.col("n")) & (F.col("all") == 5))
    assert right.distinct().collect() == [(True,)]
    assert len(hot_groups(df, ["k"])) == 12_000
    other = df.select("k", F.col("a").alias("b"))
    assert balanced_join(df, other, ["k"]).count() == 300_000


def test_hot_list_is_bounded_in_bytes(spark, skewed, hot, monkeypatch, caplog):
    """Keys that do not fit into the list are joined plainly, and the log says so."""
    hot(2)
    monkeypatch.setattr(groups, "HOT_LIST_BYTES", 100)
    df = spark.createDataFrame(skewed, "k string, a int, b int")
    found = hot_groups(df, ["k"])
    assert 0 < len(found) <= 4 and "adaptive" in caplog.text
    met = balanced_join(df, df.select("k", F.col("b").alias("c")), ["k"])
    assert met.count() == sum(len(g) ** 2 for k, g in by_key(skewed).items() if k is not None)


def test_hot_groups_found(spark, skewed, hot):
    hot(50)
    df = spark.createDataFrame(skewed, "k string, a int, b int")
    counts = {k: len(g) for k, g in by_key(skewed).items()}
    found = {r["k"]: r["_rows"] for r in hot_groups(df, ["k"])}
    assert found == {k: n for k, n in counts.items() if n > 50}


def test_hot_groups_found_in_a_sample(spark, hot):
    hot(20_000)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    df = spark.range(300_000).select(key.alias("k"), F.col("id").alias("a"))
    found = hot_groups(df, ["k"])
    assert [r["k"] for r in found] == ["hot"]
    assert found[0]["_rows"] == pytest.approx(100_000, rel=0.1)
    grouped = OrderedGroups(df, ["k"], ["a"]).running({"n": F.lit(1)}, totals={"n": "all"})
    assert grouped.is_split
    right = grouped.done().where("k = 'hot'").select((F.col("a") / 3 + 1 == F.col("n")) & (F.col("all") == 100_000))
    assert right.distinct().collect() == [(True,)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins(spark, skewed, sizes, how):
    other = [(k, i) for i, k in enumerate(["hot"] * 60 + ["a"] * 9 + ["k1", "k2", "x", None])]
    left = spark.createDataFrame(skewed, "k string, a int, b int").drop("a")
    right = spark.createDataFrame(other, "k string, c int")
    expected = []
    for k, _, b in skewed:
        met = [c for key, c in other if key == k and k is not None]
        if not met and how == "left":
            met = [None]
        expected += [(k, b, c) for c in met]
    out = balanced_join(left, right, ["k"], how)
    assert rows(out.select("k", "b", "c")) == sorted(expected, key=repr)


def test_join_with_unique_right_side(spark, skewed, sizes):
    left = spark.createDataFrame(skewed, "k string, a int, b int").drop("a")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, c int")
    met = {"hot": 1, "k3": 2}
    out = balanced_join(left, right, ["k"], "left", right_unique=True)
    expected = [(k, b, met.get(k)) for k, _, b in skewed]
    assert rows(out.select("k", "b", "c")) == sorted(expected, key=repr)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_as_keys_and_order(spark, hot, zone):
    hot(3)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Hours around the night a clock is set back, as instants.
        df = spark.range(40).select(
            F.timestamp_seconds(F.lit(1604192400) + F.floor(F.col("id") / 20) * 3600).alias("k"),
            F.timestamp_seconds(1604192400 + F.col("id") * 600).alias("t"),
            F.timestamp_seconds(1604192400 + F.col("id") * 600).cast("date").alias("d"),
        )
        grouped = OrderedGroups(df, ["k"], ["d", "t"]).running({"n": F.lit(1)})
        assert grouped.rows.select("k", "_part").distinct().count() > 3
        assert sorted(r.n for r in grouped.done().collect()) == sorted([*range(1, 21)] * 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
