import random
from itertools import groupby

from conftest import rows
from pyspark.sql import functions as F

import tablelens as tl


def expected_runs(data):
    out = []
    for key in sorted({k for k, _, _ in data}, key=repr):
        values = [v for _, _, v in sorted(r for r in data if r[0] == key)]
        at = 0
        for number, (value, run) in enumerate(groupby(values), 1):
            size = len(list(run))
            out.append((key, number, value, at + 1, at + size, size, len(values)))
            at += size
    return sorted(out, key=repr)


def test_runs(spark, either):
    rng = random.Random(9)
    data = [("k1", i, rng.choice(["a", "b", None])) for i in range(80)]
    data += [("k2", i, "same") for i in range(30)] + [("k3", 0, None)]
    df = spark.createDataFrame(data, "k string, o int, v string")
    out = tl.runs(df, ["k"], ["o"], "v")
    assert rows(out) == expected_runs(data)
    assert out.agg(F.sum("len")).first()[0] == len(data)


def test_run_lists(spark, either):
    data = [("k", i, v) for i, v in enumerate("aabcaab")] + [("one", i, "z") for i in range(3)]
    df = spark.createDataFrame(data, "k string, o int, v string")
    found = tl.runs(df, ["k"], ["o"], "v")
    assert rows(tl.run_lists(found, ["k"], "v", skip="c")) == [
        ("k", "a", 0, "1 TO 2, 5 TO 6"),
        ("k", "b", 0, "3, 7"),
        ("one", "z", 0, "ALL"),
    ]


def test_ordered_list(spark, either):
    data = [("k", 3, "c", False), ("k", 1, "a", True), ("k", 2, None, True), ("m", 1, "x", False)]
    df = spark.createDataFrame(data, "k string, o int, v string, d boolean")
    suffix = F.when(F.col("d"), " DESC")
    assert rows(tl.ordered_list(df, ["k"], ["o"], "v", suffix)) == [("k", 0, "a DESC, c"), ("m", 0, "x")]


def test_long_lists_go_on_in_pieces(spark, either):
    df = spark.createDataFrame([("k", i) for i in range(25)] + [("m", 1)], "k string, v int")
    out = rows(tl.ordered_list(df, ["k"], ["v"], "v", piece_items=10))
    assert [(k, p) for k, p, _ in out] == [("k", 0), ("k", 1), ("k", 2), ("m", 0)]
    assert ", ".join(t for k, _, t in out if k == "k") == ", ".join(map(str, range(25)))


def test_collapse_list(spark, either):
    data = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("b", None), ("c", "x"), ("c", "y"), ("c", "z")]
    df = spark.createDataFrame(data, "k string, v string")
    assert rows(tl.collapse_list(df, ["k"], "v")) == [("a", 0, "x, y"), ("b", 0, "y"), ("c", 0, "ALL")]
    assert rows(tl.collapse_list(df, ["k"], "v", full=["y", "x"])) == [
        ("a", 0, "ALL"),
        ("b", 0, "y"),
        ("c", 0, "x, y, z"),
    ]
    pieces = tl.collapse_list(df, ["k"], "v", full=["x", "y"], piece_items=1)
    assert rows(pieces) == [
        ("a", 0, "ALL"),
        ("b", 0, "y"),
        ("c", 0, "x"),
        ("c", 1, "y"),
        ("c", 2, "z"),
    ]


def test_scoped_rules(spark, either):
    rules = spark.createDataFrame(
        [("db", None, "sel", "G"), ("db", None, "ins", "G"), ("db", None, "del", "D"), ("grp", 1, "upd", "W"), ("one", 7, "x", "G"), ("other", 7, "no", "G")],
        "scope string, key int, rule string, state string",
    )
    entities = spark.createDataFrame([(7, 1), (8, 1), (9, None)], "id long, g int")
    scopes = {"db": None, "grp": "g", "one": "id"}
    out = tl.scoped_rules(rules, entities, "id", scopes, by=["state"])
    assert rows(out) == sorted(
        [(i, "db", s, 0, r) for i in (7, 8, 9) for s, r in (("G", "ins, sel"), ("D", "del"))]
        + [(7, "grp", "W", 0, "upd"), (8, "grp", "W", 0, "upd"), (7, "one", "G", 0, "x")],
        key=repr,
    )


def test_state_words(spark):
    df = spark.createDataFrame([("D",), ("G",), ("W",)], "s string")
    out = df.select("s", tl.state_words(F.col("s")).alias("w")).select("s", "w.*")
    assert rows(out) == [("D", "DENY", ""), ("G", "GRANT", ""), ("W", "GRANT", "WITH GRANT OPTION")]


def test_name_audit(spark):
    names = ["plain", "1st", "a b", "a]b", "Select", "x_@1", "é", None, "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    expected = {"1st": "[1st]", "a b": "[a b]", "a]b": "[a]]b]", "é": "[é]"}
    out = {r.name: r.quoted for r in tl.name_audit(df, "n", ["PLAIN"]).collect()}
    assert out == {n: n for n in names if n} | expected | {"plain": "[plain]"}
    reserved = {r.name: r.quoted for r in tl.name_audit(df, "n").collect()}
    assert reserved == {n: n for n in names if n} | expected | {"Select": "[Select]"}
