"""Edge tables and the two-hop surroundings of their nodes.

An edge points from what refers (``src``) to what is referred to (``dst``).
The functions that take ``edges`` read them several times: pass a written
table (see ``plans.tables.materialize``) when they come from a longer plan.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.plans.groups import OrderedGroups, hot_group_rows, outgrown
from tablelens.plans.joins import balanced_join
from tablelens.plans.tables import Bucketed, materialize, shared_folder

# Connectors of the graph report.
ONLY, BETWEEN = "−", "∣"
# Edges in a bucket: more would not be ordered in memory, fewer are not worth a task. The most buckets Spark allows.
BUCKET_EDGES, FEW_EDGES, MOST_BUCKETS = 500_000, 50_000, 100_000
# What an edge carries seen from one end, and the same from the other.
ENDS = [
    ("src", "dst"),
    ("_src_label", "_dst_label"),
    ("parent_row", "child_row"),
    ("parent_count", "child_count"),
    ("_in_start", "_out_start"),
    ("_in_count", "_out_count"),
    ("_src_paths", "_dst_paths"),
    ("_dst_across", "_src_across"),
]


def build_edges(sources: Iterable[DataFrame]) -> DataFrame:
    """One row per pair from several edge sources, self-loops dropped.

    Sources have ``src``, ``dst`` and any boolean flags; a flag holds for the
    pair when it holds in any source row. Pairs with an unknown end are dropped.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    flags = [c for c in rows.columns if c not in ("src", "dst")]
    pairs = rows.where(F.col("src") != F.col("dst")).groupBy("src", "dst")
    if not flags:
        return pairs.agg(F.count("*")).select("src", "dst")
    return pairs.agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def edge_ordinals(edges: DataFrame) -> DataFrame:
    """The edges with their number and count seen from both ends.

    ``parent_row`` of ``parent_count`` among those that refer to ``dst``, and
    ``child_row`` of ``child_count`` among those ``src`` refers to.
    """
    into = OrderedGroups(edges, ["dst"], ["src"]).running(
        {"parent_row": F.lit(1)}, totals={"parent_row": "parent_count"}
    )
    both = OrderedGroups(into.done(), ["src"], ["dst"], outgrown(edges, ["src"])).running(
        {"child_row": F.lit(1)}, totals={"child_row": "child_count"}
    )
    return both.done().select(
        *edges.columns, "parent_row", "parent_count", "child_row", "child_count"
    )


@dataclass(frozen=True)
class EdgeTables:
    """Edges stored twice, dealt out over buckets by either end, with their ordinals.

    Both tables hold ``src, dst, parent_row, parent_count, child_row, child_count`` and the
    further columns of the edges. What joins on an end reads the table of that end and needs
    no exchange of edges.
    """

    by_src: DataFrame
    by_dst: DataFrame

    def reversed(self) -> EdgeTables:
        """The same edges the other way round; the tables change their parts."""
        return EdgeTables(reversed_edges(self.by_dst), reversed_edges(self.by_src))


def store_edges(edges: DataFrame, buckets: int | None = None) -> EdgeTables:
    """Number the edges (see ``edge_ordinals``) and store them by either end.

    The tables lie in the shared folder, in as many buckets as there are shuffle partitions unless told
    otherwise, and are known to the session only. A node with very many edges makes its bucket
    large; joins that meet such a node deal its edges out anew.
    """
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(edge_ordinals(edges))

    def stored(end: str) -> DataFrame:
        name = f"edges_by_{end}_{uuid.uuid4().hex}"
        # Gathered by the end, every bucket is one file.
        writer = numbered.repartition(n, end).write.option("path", f"{shared_folder(spark).rstrip('/')}/{name}")
        writer.bucketBy(n, end).saveAsTable(name)
        return spark.table(name)

    return EdgeTables(stored("src"), stored("dst"))


def _by_ends(edges: DataFrame | EdgeTables) -> EdgeTables:
    return edges if isinstance(edges, EdgeTables) else EdgeTables(edges, edges)


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Every edge the other way round, with what is known of its ends."""
    other = {a: b for one, two in ENDS for a, b in ((one, two), (two, one))}
    return edges.select(*[F.col(c).alias(other.get(c, c)) for c in edges.columns])


def _first_hops(
    edges: DataFrame, focus: DataFrame | None, carried: dict[str, str] | None = None
) -> DataFrame:
    """The edges as (focus, hop1), with further edge columns under new names."""
    hops = edges.select(
        F.col("dst").alias("focus"),
        F.col("src").alias("hop1"),
        *[F.col(c).alias(n) for c, n in (carried or {}).items()],
    )
    if focus is None:
        return hops
    wanted = focus.select(F.col(focus.columns[0]).alias("focus")).distinct()
    return hops.join(wanted, "focus", "left_semi")


def two_hop_in(edges: DataFrame | EdgeTables, focus: DataFrame | None = None) -> DataFrame:
    """Who refers to each node, and who refers to them: ``(focus, hop1, hop2)``.

    A first hop nobody refers to stays, with ``hop2`` NULL. ``focus`` (a
    table whose first column names nodes) limits whose surroundings are
    listed, which a graph with nodes large in both directions needs. Edges that meet at a node
    many refer to are dealt out over tasks. ``store_edges`` saves the exchange of edges where
    they are asked more than once.
    """
    stored = _by_ends(edges)
    first = _first_hops(stored.by_src, focus)
    second = stored.by_dst.select(F.col("dst").alias("hop1"), F.col("src").alias("hop2"))
    return balanced_join(first, second, ["hop1"], "left").select("focus", "hop1", "hop2")


def two_hop_out(edges: DataFrame | EdgeTables, focus: DataFrame | None = None) -> DataFrame:
    """What each node refers to, and what those refer to: ``(focus, hop1, hop2)``."""
    return two_hop_in(_by_ends(edges).reversed(), focus)


def _mark(row: Column, count: Column, first: str, last: str) -> Column:
    """The connector of a row within its block; empty where there is no block."""
    return (
        F.when(count == 1, ONLY)
        .when(row == 1, first)
        .when(row == count, last)
        .when(row.isNotNull(), BETWEEN)
        .otherwise("")
    )


def _shown_labels(labels: DataFrame) -> DataFrame:
    """``_node`` and ``_label``, such as ``" (25)"``; none for zero."""
    node, count = labels.columns[:2]
    total = labels.groupBy(F.col(node).alias("_node")).agg(F.sum(count).alias("_n"))
    return total.where(F.col("_n") != 0).select(
        "_node", F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias("_label")
    )


def _with_labels(edges: EdgeTables, labels: DataFrame) -> EdgeTables:
    """Edges with ``_src_label`` and ``_dst_label``."""
    shown = materialize(_shown_labels(labels))

    def named(table: DataFrame) -> DataFrame:
        for end in ("src", "dst"):
            names = shown.withColumnsRenamed({"_node": end, "_label": f"_{end}_label"})
            table = balanced_join(table, names, [end], "left", right_unique=True)
        return table

    both = materialize(named(edges.by_src))
    return EdgeTables(both, both)


def _side(
    edges: EdgeTables, focus: DataFrame | None, plain: bool, way: str, first: str, last: str
) -> DataFrame:
    """One side of the layout, for those that refer to each focus.

    A path is numbered from its edges: the paths before its first hop plus the
    place of its second, which the edge brings along. How many second hops a first hop has
    is told by any of them, so nothing is counted again; only first hops are put in
    order. ``plain`` says that no node is large.
    """
    hot = [] if plain else None
    second = _second_hops(edges)
    degrees = second.where("_place = 1").select("hop1", F.col("_places").alias("_paths"))
    sized = balanced_join(
        _first_hops(edges.by_src, focus, _carried(edges)), degrees, ["hop1"], "left", right_unique=True, hot=hot
    ).withColumn("_paths", F.coalesce("_paths", F.lit(1)))
    blocks = (
        OrderedGroups(sized, ["focus"], ["hop1"], hot)
        .running({"_end": F.col("_paths")}, totals={"_end": "_count"})
        .done()
        .withColumn("_start", F.col("_end") - F.col("_paths"))
        .drop("_end", "_paths")
    )
    return _path_rows(balanced_join(blocks, second, ["hop1"], "left", hot=hot), way, first, last)


def _carried(edges: EdgeTables) -> dict[str, str]:
    """What first hops bring along, with its names."""
    names = {"_rel": "_rel1", "_src_label": "_label1", "_dst_label": "_label0"}
    return {c: n for c, n in names.items() if c in edges.by_src.columns}


def _second_hops(edges: EdgeTables) -> DataFrame:
    names = {"dst": "hop1", "src": "hop2", "parent_row": "_place", "parent_count": "_places", "_rel": "_rel2", "_src_label": "_label2"}
    return edges.by_dst.select(*[F.col(c).alias(n) for c, n in names.items() if c in edges.by_dst.columns])


def _path_rows(paths: DataFrame, way: str, first: str, last: str) -> DataFrame:
    """The rows of one side, for first hops (with ``_start`` and ``_count``) and their second hops."""
    row = F.col("_start") + F.coalesce("_place", F.lit(1))
    columns = {
        "focus": F.col("focus"),
        "ordinal": row - F.expr("_count div 2"),
        f"{way}2": _labelled("hop2", "_label2", paths),
        f"{way}2_mark": _mark(F.col("_place"), F.col("_places"), first, last),
        f"{way}1": _labelled("hop1", "_label1", paths),
        f"show_{way}1": F.coalesce(F.col("_place") == F.expr("_places div 2 + 1"), F.lit(True)),
        f"{way}_mark": _mark(row, F.col("_count"), first, last),
    }
    if "_rel1" in paths.columns:
        columns |= {f"{way}2_rel": F.col("_rel2"), f"{way}1_rel": F.col("_rel1")}
    if "_label0" in paths.columns:
        columns[f"_{way}_label"] = F.col("_label0")
    if "_across" in paths.columns:
        columns["_across"] = F.col("_across")
    return paths.select(*[c.alias(n) for n, c in columns.items()])


def _laid_out(edges: DataFrame, labels: DataFrame | None) -> EdgeTables:
    """All that the layout of every node asks of an edge, by either end, where no node is large.

    Edges go from one end to the other four times, and each time are written in
    buckets by the end they have come to, with what that end knows: how many refer to
    ``src`` (``_src_paths``), how many ``dst`` refers to (``_dst_paths``), and the sums of these
    along the hops of a focus. ``_dst_across`` is the number of paths on the other side of
    the focus ``dst`` if it has any, and ``_src_across`` likewise. No more than one
    exchange of edges lies on disk at a time; a table is removed when the next has taken its place.
    """
    n, one = _buckets(edges), F.lit(1)
    shown = None if labels is None else Bucketed(_shown_labels(labels).repartition(n, "_node"), n, "_node")

    def known(table: DataFrame, facts: DataFrame, end: str) -> DataFrame:
        return table.join(facts.hint("merge"), end, "left")

    def named(table: DataFrame, end: str) -> DataFrame:
        if shown is None:
            return table
        return known(table, shown.table.withColumnsRenamed({"_node": end, "_label": f"_{end}_label"}), end)

    referring = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("_src_paths"))
    referring = Bucketed(referring.repartition(n, "src"), n, "src")
    moved = known(edges.repartition(n, "src"), referring.table, "src")
    by_src = Bucketed(named(moved, "src"), n, "src", ["dst"])

    referred = by_src.table.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_dst_paths"))
    moved = known(by_src.table.repartition(n, "dst"), referred, "dst")
    by_dst = Bucketed(named(moved, "dst"), n, "dst", ["src"])
    for table in [referring, by_src] + [shown] * (shown is not None):
        table.discard()

    out = by_dst.table.where("_src_paths IS NOT NULL").groupBy(F.col("src").alias("dst"))
    out = out.agg(F.sum(F.coalesce("_dst_paths", one)).alias("_dst_across"))
    out = Bucketed(out.repartition(n, "dst"), n, "dst")
    into = by_dst.table.where("_dst_paths IS NOT NULL").groupBy(F.col("dst").alias("src"))
    into = into.agg(F.sum(F.coalesce("_src_paths", one)).alias("_src_across"))
    behind, ahead = F.coalesce("_src_paths", one), F.coalesce("_dst_paths", one)
    moved = known(by_dst.table, out.table, "dst")
    rows = OrderedGroups(moved, ["dst"], ["src"], hot=False).running({"_end": behind}, {"_end": "_in_count"}).done()
    rows = rows.withColumn("_in_start", F.col("_end") - behind).drop("_end")
    moved = known(rows.repartition(n, "src"), into, "src")
    rows = OrderedGroups(moved, ["src"], ["dst"], hot=False).running(
        {"_end": ahead, "child_row": one}, {"_end": "_out_count", "child_row": "child_count"}
    )
    rows = rows.done().withColumn("_out_start", F.col("_end") - ahead).drop("_end")
    laid = Bucketed(rows, n, "src", ["dst"])
    by_dst.discard()
    out.discard()

    wanted = ["src", "dst", "_rel", "_src_label", "_dst_label", "_out_start", "_out_count", "_dst_paths", "_src_across"]
    moved = laid.table.select(*[c for c in wanted if c in laid.table.columns]).repartition(n, "dst")
    rows = OrderedGroups(moved, ["dst"], ["src"], hot=False).running({"parent_row": one}, {"parent_row": "parent_count"})
    return EdgeTables(laid.table, Bucketed(rows.done(), n, "dst", ["src"]).table)


def _buckets(edges: DataFrame) -> int:
    rows, parts = edges.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(rows / BUCKET_EDGES, min(rows / FEW_EDGES, parts), 1)
    return min(math.ceil(wanted), MOST_BUCKETS)


def _meeting(edges: EdgeTables, way: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """One side of the layout: rows that meet a row of the other side, and rows that stand alone.

    A side has one row for each ordinal around 1, so the numbers of paths tell which rows meet.
    Only those need a join.
    """
    more = {"_in_start": "_start", "_in_count": "_count", "_src_paths": "_paths", "_dst_across": "_across"}
    hops = _first_hops(edges.by_src, None, _carried(edges) | more)
    least, most = F.expr("1 - _across div 2"), F.expr("_across - _across div 2")
    begins, ends = F.expr("_start + 1 - _count div 2"), F.expr("_start + coalesce(_paths, 1) - _count div 2")
    meets = F.coalesce(F.col("ordinal").between(least, most), F.lit(False))

    def rows(some: DataFrame, wanted: Column) -> DataFrame:
        paths = some.join(_second_hops(edges).hint("merge"), "hop1", "left")
        return _path_rows(paths, way, first, last).where(wanted).drop("_across")

    return rows(hops.where((begins <= most) & (ends >= least)), meets), rows(hops, ~meets)


def _labelled(name: str, label: str, rows: DataFrame) -> Column:
    if label not in rows.columns:
        return F.col(name)
    return F.concat(name, F.coalesce(label, F.lit("")))


def _named_relation(edges: EdgeTables, relations: str | None) -> EdgeTables:
    rel = [F.col(relations).alias("_rel")] if relations else []
    wanted = ["src", "dst", "parent_row", "parent_count", "child_row", "child_count", *rel]
    return EdgeTables(edges.by_src.select(*wanted), edges.by_dst.select(*wanted))


def _has_hub(edges: EdgeTables) -> bool:
    """Whether any node has more edges than one task takes; the edges tell themselves."""
    most = edges.by_src.agg(F.greatest(F.max("parent_count"), F.max("child_count"))).first()[0]
    return (most or 0) > hot_group_rows(edges.by_src.sparkSession)


def _may_have_hub(edges: DataFrame) -> bool:
    """The same of edges that are not numbered, by a sample."""
    return outgrown(edges, ["dst"]) or outgrown(edges, ["src"])


def graph_layout(
    edges: DataFrame | EdgeTables,
    focus: DataFrame | None = None,
    labels: DataFrame | None = None,
    relations: str | None = None,
) -> DataFrame:
    """The two-hop surroundings of each node as aligned rows.

    Columns from left to right: ``focus, ordinal``, the second and first hop
    that refer to the focus (``in2, in2_mark, in1, show_in1, in_mark``), the
    focus itself on ordinal 1 (``node``), and the first and second hop it
    refers to (``out_mark, out1, show_out1, out2_mark, out2``). Marks are the
    connectors beside a hop. The ``show`` flags tell the one row of a block
    that prints the name of its first hop.

    ``labels`` (node, count) adds ``" (count)"`` to each name unless the
    count is zero. ``relations`` names an edge column to show for each of the
    four hops, as ``in2_rel, in1_rel, out1_rel, out2_rel``. Edges that are not stored by
    ``store_edges`` are numbered first; where every node is a focus and none is large, they
    are stored by both ends with the place of their rows (see ``_laid_out``).
    """
    up, down = ("\\", "/"), ("/", "\\")
    if not isinstance(edges, EdgeTables) and focus is None and not _may_have_hub(edges):
        rel = [F.col(relations).alias("_rel")] if relations else []
        laid = _laid_out(edges.select("src", "dst", *rel), labels)
        (into, into_alone), (out, out_alone) = _meeting(laid, "in", *up), _meeting(laid.reversed(), "out", *down)
        alone = into_alone.unionByName(out_alone, allowMissingColumns=True)
    else:
        if not isinstance(edges, EdgeTables):
            rel = [relations] if relations else []
            edges = _by_ends(materialize(edge_ordinals(edges.select("src", "dst", *rel))))
        stored = _named_relation(edges, relations)
        plain = not _has_hub(stored)
        if labels is not None:
            stored = _with_labels(stored, labels)
        into, out = _side(stored, focus, plain, "in", *up), _side(stored.reversed(), focus, plain, "out", *down)
        alone = None

    rows = into.join(out, ["focus", "ordinal"], "full")
    if alone is not None:
        rows = rows.unionByName(alone)
    name = F.col("focus")
    if labels is not None:
        name = F.concat(name, F.coalesce("_in_label", "_out_label", F.lit("")))
    marks = ["in2_mark", "in_mark", "out_mark", "out2_mark"]
    rows = rows.withColumns({m: F.coalesce(m, F.lit("")) for m in marks})
    return rows.select(
        "focus",
        "ordinal",
        "in2",
        *(["in2_rel"] if relations else []),
        "in2_mark",
        "in1",
        "show_in1",
        *(["in1_rel"] if relations else []),
        "in_mark",
        F.when(F.col("ordinal") == 1, name).otherwise("").alias("node"),
        "out_mark",
        *(["out1_rel"] if relations else []),
        "out1",
        "show_out1",
        "out2_mark",
        *(["out2_rel"] if relations else []),
        "out2",
    )
