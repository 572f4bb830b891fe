"""Edges stored by their ends: same results, no exchange of edges."""

import random

from conftest import rows

import tablelens as tl


def random_edges(spark, n=120, nodes=25):
    dice = random.Random(6)
    pairs = {(f"n{dice.randrange(nodes)}", f"n{dice.randrange(nodes)}") for _ in range(n)}
    return spark.createDataFrame([(a, b, a < b) for a, b in pairs if a != b], "src string, dst string, up boolean")


def test_same_results(spark, either):
    edges = random_edges(spark)
    stored = tl.store_edges(edges, buckets=3)
    focus = spark.createDataFrame([("n1",), ("n2",), ("none",)], "node string")
    for f in (tl.two_hop_in, tl.two_hop_out):
        assert rows(f(stored, focus)) == rows(f(edges, focus))
    labels = edges.selectExpr("src AS node", "length(dst) AS n")
    for more in ({}, {"labels": labels, "relations": "up", "focus": focus}):
        assert rows(tl.graph_layout(stored, **more)) == rows(tl.graph_layout(edges, **more))


def test_no_exchange_on_the_side_of_the_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = tl.store_edges(random_edges(spark), buckets=8)
        for hops in (tl.two_hop_in(stored), tl.two_hop_out(stored)):
            plan = hops._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        # The layout orders first hops by focus, brings them to their second hops, and meets the other
        # side: three exchanges a side but none of them of stored edges.
        plan = tl.graph_layout(stored)._jdf.queryExecution().executedPlan().toString()
        for at, line in enumerate(lines := plan.splitlines()):
            if "Exchange" in line:
                assert "Scan parquet" not in "".join(lines[at + 1 : at + 4])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
