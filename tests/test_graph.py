import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.operators.graph import _laid_out, _meeting


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture(scope="module")
def pairs():
    """A hub many refer to, which itself refers to several."""
    rng = random.Random(4)
    found = {(f"n{i}", "hub") for i in range(40)} | {("hub", f"n{i}") for i in range(35, 50)}
    found |= {(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}") for _ in range(60)}
    return sorted((a, b) for a, b in found if a != b)


def paths(pairs):
    into = defaultdict(list)
    for a, b in pairs:
        into[b].append(a)
    return [(f, m, x) for m, f in pairs for x in (into[m] or [None])]


def test_build_edges(spark):
    one = spark.createDataFrame([("a", "b", False), ("a", "b", True), ("c", "c", True), (None, "x", True)], "src string, dst string, f boolean")
    two = spark.createDataFrame([("a", "c"), ("a", "b")], "src string, dst string")
    assert rows(tl.build_edges([one, two])) == [("a", "b", True), ("a", "c", False)]
    assert rows(tl.build_edges([two, two])) == [("a", "b"), ("a", "c")]


def test_ordinals(spark, either):
    out = tl.edge_ordinals(edges(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("a", "y")]))
    assert rows(out) == [
        ("a", "x", 1, 3, 1, 2),
        ("a", "y", 1, 1, 2, 2),
        ("b", "x", 2, 3, 1, 1),
        ("c", "x", 3, 3, 1, 1),
    ]


def test_two_hops(spark, pairs, either):
    e = edges(spark, pairs)
    assert rows(tl.two_hop_in(e)) == sorted(paths(pairs), key=repr)
    turned = [(b, a) for a, b in pairs]
    assert rows(tl.two_hop_out(e)) == sorted(paths(turned), key=repr)
    assert rows(tl.two_hop_out(e)) == rows(tl.two_hop_in(edges(spark, turned)))


def test_focus(spark, pairs, either):
    focus = spark.createDataFrame([("hub",), ("n1",), ("n1",), ("nowhere",)], "node string")
    out = tl.two_hop_in(edges(spark, pairs), focus)
    assert rows(out) == sorted([p for p in paths(pairs) if p[0] in ("hub", "n1")], key=repr)


def test_layout_of_one_node(spark, either):
    e = edges(spark, [("a", "f"), ("b", "f"), ("x", "a"), ("y", "a"), ("z", "a"), ("f", "k")])
    focus = spark.createDataFrame([("f",)], "node string")
    out = tl.graph_layout(e, focus).orderBy("ordinal").collect()
    assert [tuple(r) for r in out] == [
        ("f", -1, "x", "\\", "a", False, "\\", "", "", None, None, "", None),
        ("f", 0, "y", "∣", "a", True, "∣", "", "", None, None, "", None),
        ("f", 1, "z", "/", "a", False, "∣", "f", "−", "k", True, "", None),
        ("f", 2, None, "", "b", True, "/", "", "", None, None, "", None),
    ]


def test_layout_with_labels_and_relations(spark, either):
    e = spark.createDataFrame([("a", "f", "r1"), ("x", "a", "r2"), ("f", "k", "r3"), ("k", "q", "r4")], "src string, dst string, rel string")
    counts = spark.createDataFrame([("f", 2), ("f", 3), ("a", 0), ("x", 7), ("k", 1)], "node string, n long")
    focus = spark.createDataFrame([("f",)], "node string")
    out = tl.graph_layout(e, focus, labels=counts, relations="rel").collect()
    assert [r.asDict() for r in out] == [
        {
            "focus": "f", "ordinal": 1, "in2": "x (7)", "in2_rel": "r2", "in2_mark": "−", "in1": "a",
            "show_in1": True, "in1_rel": "r1", "in_mark": "−", "node": "f (5)", "out_mark": "−",
            "out1_rel": "r3", "out1": "k (1)", "show_out1": True, "out2_mark": "−", "out2_rel": "r4",
            "out2": "q",
        }
    ]


def test_layout_holds_every_path_once(spark, pairs, either):
    out = tl.graph_layout(edges(spark, pairs)).collect()
    got = [(r.focus, r.in1, r.in2) for r in out if r.in1 is not None]
    assert sorted(got, key=repr) == sorted(paths(pairs), key=repr)
    turned = paths([(b, a) for a, b in pairs])
    got = [(r.focus, r.out1, r.out2) for r in out if r.out1 is not None]
    assert sorted(got, key=repr) == sorted(turned, key=repr)
    assert sorted(r.node for r in out if r.node) == sorted({r.focus for r in out})
    for focus in {r.focus for r in out}:
        ordinals = sorted(r.ordinal for r in out if r.focus == focus and r.in1 is not None)
        if ordinals:
            assert ordinals == list(range(ordinals[0], ordinals[0] + len(ordinals)))


def paired(df):
    """Rows by name, so that tables with other orders of columns can be compared."""
    return sorted(map(repr, (sorted(r.asDict().items()) for r in df.collect())))


def test_layout_of_every_node_agrees_with_that_of_stored_edges(spark):
    """Repeated edges and unknown ends too; stored edges are laid out by another plan."""
    dice = random.Random(9)
    found = [(f"n{dice.randrange(30)}", f"n{dice.randrange(30)}") for _ in range(90)] + [(f"n{i}", "hub") for i in range(20)]
    found += [("hub", "n1"), ("hub", "n2"), ("hub", "n2"), (None, "n3"), ("n4", None), (None, "n3"), (None, None)]
    e = tl.materialize(edges(spark, found))
    labels = spark.createDataFrame([("hub", 3), ("n1", 0), ("n2", 4), ("n2", 1), (None, 9)], "node string, n long")
    signs = e.withColumn("sign", F.concat(F.col("src"), F.lit(">"), F.col("dst")))
    asked = [(e, {}), (e, {"labels": labels}), (signs, {"labels": labels, "relations": "sign"})]
    for x, more in asked:
        assert paired(tl.graph_layout(x, **more)) == paired(tl.graph_layout(tl.store_edges(x, 3), **more))


def test_layout_of_every_node_exchanges_only_rows_that_meet(spark, pairs):
    """Neither edges nor paths move while the layout is written; both were moved five times a side."""
    e = tl.materialize(edges(spark, pairs))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tl.graph_layout(e)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and all("focus" in line and "ordinal" in line for line in moved)


def test_layout_moves_few_rows_where_one_side_is_short(spark):
    """A chain of many to one: of 1,000 paths into the last node one meets the path that leads out."""
    found = [(f"a{i}", f"b{i % 10}") for i in range(1000)] + [(f"b{i}", "c") for i in range(10)] + [("c", "d")]
    rows_in, alone = _meeting(_laid_out(edges(spark, found), None), "in", "\\", "/")
    assert [(r.focus, r.ordinal) for r in rows_in.where("focus = 'c'").collect()] == [("c", 1)]
    assert alone.where("focus = 'c'").count() == 999
    assert sorted(r.focus for r in rows_in.collect()) == sorted([f"b{i}" for i in range(10)] + ["c"])
