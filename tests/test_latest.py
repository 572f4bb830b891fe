"""The latest right row up to a point, against brute force."""

import random

import pytest
from conftest import rows

import tablelens as tl


def brute(left, right, strict, after):
    out = []
    for i, k, at in left:
        fits = [
            (t, n, w) for key, t, n, w in right
            if None not in (k, at, key, t) and key == k
            and ((t > at or (t == at and not strict)) if after else (t < at or (t == at and not strict)))
        ]
        best = (min if after else max)(fits, default=None)
        out.append((i, k, at, *(best[:2] if best else (None, None)), best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("after", [False, True])
def test_against_brute_force(spark, either, strict, after):
    dice = random.Random(4)
    keys = ["a", "a", "a", "b", "c", None]
    left = [(i, dice.choice(keys), dice.choice([None, *range(20)])) for i in range(80)]
    left += [(99, "a", 7)] * 3
    right = [(dice.choice(keys[:5] + [None]), dice.choice([None, *range(20)]), n, dice.choice(["x", None])) for n in range(60)]
    l = spark.createDataFrame(left, "n int, k string, at int")
    r = spark.createDataFrame(right, "key string, t int, n int, w string")
    got = tl.latest_match(l, r, {"k": "key"}, ("at", "t"), ["n"], strict=strict, after=after)
    assert got.columns == ["n", "k", "at", "t", "right_n", "w"]
    assert rows(got) == brute(left, right, strict, after)


def test_a_match_of_nulls_is_a_match_and_empty_sides(spark):
    l = spark.createDataFrame([(1, 5)], "k int, at int")
    r = spark.createDataFrame([(1, 4, "old"), (1, 5, None)], "k int, t int, w string")
    args = ({"k": "k"}, ("at", "t"))
    assert rows(tl.latest_match(l, r, *args, columns=["w"], prefix="its_")) == [(1, 5, None)]
    assert tl.latest_match(l, r, *args, columns=["w"], prefix="its_").columns == ["k", "at", "its_w"]
    assert rows(tl.latest_match(l, r.limit(0), *args)) == [(1, 5, None, None)]
    assert rows(tl.latest_match(l.limit(0), r, *args)) == []


def test_one_shuffle_and_no_join(spark):
    l = spark.createDataFrame([(1, 5)], "k int, at int")
    r = spark.createDataFrame([(1, 4, "old")], "k int, t int, w string")
    plan = tl.latest_match(l, r, {"k": "k"}, ("at", "t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_first_match_tells_the_sides_apart(spark):
    l = spark.createDataFrame([(1, "l"), (2, "m")], "k int, v string")
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, v string")
    got = tl.first_match(l, r, {"k": "k"}, ["n"])
    assert got.columns == ["k", "v", "n", "right_v"]
    assert rows(got) == [(1, "l", 1, "a"), (2, "m", None, None)]
    assert tl.first_match(l, r, {"k": "k"}, ["n"], prefix="r_").columns == ["k", "v", "r_n", "r_v"]
