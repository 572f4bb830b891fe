"""The hierarchical search report, and hits on containers as a whole."""

import random
from collections import defaultdict

import pytest
from conftest import rows

import tablelens as tl

HITS = [
    ("docs", 1, 3, "c", "about docs", 10, None),
    ("docs", 1, 1, "a", "about docs", 10, None),
    ("docs", 1, 1, "b", "about docs", 10, None),
    ("docs", 1, 2, "b", "about docs", 10, None),
    ("docs", 2, None, "whole", "about docs", None, 5),
    ("docs", 3, None, "whole", "about docs", 1200, 5),
    ("docs", 3, 9, "z", "about docs", 1200, 5),
    ("pages", None, None, "all", None, None, None),
    ("pages", None, 7, "lost", None, None, None),
    (None, 5, 1, "x", "nameless", None, None),
]
SCHEMA = "src string, parent int, line int, snippet string, note string, lines int, n int"


def report(spark, hits=HITS, **more):
    df = spark.createDataFrame(hits, SCHEMA)
    return tl.search_report(df, ["src", "parent", "line"], "snippet", {"src": ["note"], "parent": ["lines"]}, "lines", "n", **more)


def test_report(spark, either):
    got = report(spark)
    assert got.columns == ["level", "src", "parent", "line", "n_hits", "is_hit", "ordinal", "siblings", "mark", "size_label", "text", "note", "lines"]
    assert rows(got) == sorted(
        [
            (1, None, None, None, 1, False, 1, 3, "", "", None, "nameless", None),
            (2, None, 5, None, 1, False, 1, 1, "5", "", None, None, None),
            (3, None, 5, 1, 1, True, 1, 1, "\\", "", "x", None, None),
            (1, "docs", None, None, 7, False, 2, 3, "", "", None, "about docs", None),
            (2, "docs", 1, None, 4, False, 1, 3, "docs.1", "10 lines", None, None, 10),
            (3, "docs", 1, 1, 2, True, 1, 3, "/", "", "a", None, None),
            (3, "docs", 1, 2, 1, True, 2, 3, "|", "", "b", None, None),
            (3, "docs", 1, 3, 1, True, 3, 3, "\\", "", "c", None, None),
            (2, "docs", 2, None, 1, True, 2, 3, "docs.2", "5 rows", "whole", None, None),
            (2, "docs", 3, None, 2, True, 3, 3, "docs.3", "1,200 lines", "whole", None, 1200),
            (3, "docs", 3, 9, 1, True, 1, 1, "\\", "", "z", None, None),
            (1, "pages", None, None, 2, True, 3, 3, "", "", "all", None, None),
        ],
        key=repr,
    )


def test_report_in_order_and_without_hits(spark):
    shown = [(r.level, r.src, r.parent, r.line) for r in report(spark, sort=True).collect()]
    assert shown == sorted(shown, key=lambda r: tuple((v is not None, v) for v in r[1:]))
    assert report(spark, []).collect() == []


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_counts_at_any_depth(spark, either, depth):
    dice = random.Random(depth)
    levels = [f"l{i}" for i in range(depth)]
    hits = []
    for _ in range(200):
        reached = dice.randint(1, depth)
        hits.append(tuple(dice.randrange(4) if i < reached else None for i in range(depth)))
    below, own = defaultdict(int), defaultdict(int)
    for h in hits:
        path = tuple(v for v in h if v is not None)
        own[path] += 1
        for i in range(1, len(path) + 1):
            below[path[:i]] += 1
    got = tl.search_report(spark.createDataFrame(hits, ", ".join(f"{c} int" for c in levels)), levels)
    found = {tuple(r[c] for c in levels[: r.level]): (r.n_hits, r.is_hit, r.ordinal, r.siblings) for r in got.collect()}
    want = {}
    for path, n in below.items():
        family = sorted(p for p in below if len(p) == len(path) and p[:-1] == path[:-1])
        want[path] = (n, path in own, family.index(path) + 1, len(family))
    assert found == want


def test_one_aggregate(spark):
    plan = report(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "Join" not in plan


def test_outline_draws_no_detail_for_a_hit_on_the_item(spark, either):
    hits = spark.createDataFrame([("g", 1, None), ("g", 1, 4), ("g", 1, 6), ("g", 2, None), ("h", 3, None), ("h", 3, None)], "g string, i int, line int")
    got = tl.search_outline(hits, "g", "i", "line").select("g", "item_no", "detail_no", "mark", "line")
    assert rows(got) == [
        ("g", 0, 0, "", None),
        ("g", 1, 0, "g.1", None),
        ("g", 1, 1, "/", 4),
        ("g", 1, 2, "\\", 6),
        ("g", 2, 0, "g.2", None),
        ("h", 0, 0, "", None),
        ("h", 1, 0, "h.3", None),
    ]


def test_containers_keep_all_columns_of_hits(spark):
    hits = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (2, None, "c")], "p int, c int, snippet string")
    assert rows(tl.add_containers(hits, "c", "p")) == [
        ("container", 1, None, None),
        ("container", 2, None, "c"),
        ("item", 1, 7, "a"),
        ("item", 1, 8, "b"),
    ]
