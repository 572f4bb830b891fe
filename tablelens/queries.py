"""The registered queries: every operator over whole tables.

Each takes a session and a folder of parquet tables and returns a DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions.texts import line_breaks
from tablelens.functions.widths import row_bytes
from tablelens.plans.groups import HOT_GROUP_ROWS, OrderedGroups, outgrown
from tablelens.sources.tables import Tables

LICENCE = "licen[sc]e"
YEAR_STARTS = [dt.datetime(y, 1, 1) for y in (1996, 1997, 1999, 2001)]
KEYWORDS = ["VIEW", "ERROR", "ORDER", "MACHINERY", "ASIA"]


def like_any(spark: SparkSession, folder: str) -> DataFrame:
    pages = Tables(spark, folder)("pages")
    return tl.like_any(pages, ["url", "html"], ["/1[0-4]_page", LICENCE]).select("page_id")


def like_any_literal(spark: SparkSession, folder: str) -> DataFrame:
    """A literal in its own case, which the scan filters by."""
    pages = Tables(spark, folder)("pages")
    return tl.like_any(pages, "url", "example.com/", case_sensitive=True).select("page_id", "url")


def grep_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tl.grep_lines(Tables(spark, folder)("documents"), "doc_id", "text", LICENCE)


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tl.line_counts(Tables(spark, folder)("documents"), "doc_id", "text")


def search_union(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    words = [LICENCE, "version"]
    return tl.search_union(
        [
            tl.Source("documents", t("documents"), "doc_id", "text", by_line=True),
            tl.Source("pages", t("pages"), "page_id", "url", pattern=[*words, "/1"]),
            tl.Source("benchmark", t("benchmark"), "item_id", "text", pattern="tion"),
            tl.Source(
                "conversations", t("conversations"), "conv_id", "text", "turn", pattern="the"
            ),
        ],
        words,
    )


def add_containers(spark: SparkSession, folder: str) -> DataFrame:
    turns = tl.like_any(Tables(spark, folder)("conversations"), "text", "tion")
    hits = tl.materialize(turns.select("conv_id", "turn"))
    return tl.add_containers(hits, "turn", "conv_id", kinds=("turn", "conversation"))


def search_outline(spark: SparkSession, folder: str) -> DataFrame:
    documents = Tables(spark, folder)("documents")
    sized = documents.withColumn("n_breaks", line_breaks(F.col("text")))
    # Hits are few beside the texts: written once, the texts are searched once.
    hits = tl.materialize(
        tl.grep_lines(sized, "doc_id", "text", LICENCE, keep=["source", "n_breaks"])
    )
    return tl.search_outline(
        hits, "source", "doc_id", "line", show=["line_text"], line_count="n_breaks"
    )


def search_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents, pages as a whole and turns of conversations in one report."""
    t = Tables(spark, folder)

    def hits(df: DataFrame, src: str, about: str, parent: str, item: str, text: str, **more: F.Column) -> DataFrame:
        nothing = {"origin": F.lit(None).cast("string"), "lines": F.lit(None).cast("long"), "turns": F.lit(None).cast("long")}
        columns = {"parent_id": F.col(parent), "item_no": F.expr(item).cast("long"), "snippet": F.col(text)} | nothing | more
        return df.select(F.lit(src).alias("src"), F.lit(about).alias("about"), *[c.alias(n) for n, c in columns.items()])

    sized = t("documents").withColumn("n_breaks", line_breaks(F.col("text")))
    lines = tl.grep_lines(sized, "doc_id", "text", LICENCE, keep=["source", "n_breaks"])
    pages = tl.like_any(t("pages"), ["url", "html"], ["/1[0-4]_page", LICENCE])
    turns = tl.like_any(t("conversations"), "text", "tion")
    lengths = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    found = [
        hits(lines, "documents", "texts by line", "doc_id", "line", "line_text", origin=F.col("source"), lines=F.col("n_breaks")),
        hits(pages, "pages", "web pages", "page_id", "NULL", "url"),
        hits(turns.join(lengths, "conv_id"), "conversations", "dialogues", "conv_id", "turn", "text", turns=F.col("n_turns")),
    ]
    return tl.search_report(
        found[0].unionByName(found[1]).unionByName(found[2]),
        ["src", "parent_id", "item_no"],
        "snippet",
        {"src": ["about"], "parent_id": ["origin"]},
        line_count="lines",
        row_count="turns",
    )


def text_preview(spark: SparkSession, folder: str) -> DataFrame:
    return tl.text_preview(Tables(spark, folder)("documents"), "doc_id", "text", max_lines=5)


def header_sections(spark: SparkSession, folder: str) -> DataFrame:
    headed = Tables(spark, folder)("part").select(
        "p_partkey",
        F.concat(
            F.lit("NAME:   "),
            "p_name",
            F.lit("\n        "),
            "p_brand",
            F.lit("\n\nTYPE:   "),
            "p_type",
            F.lit("\n\n"),
        ).alias("txt"),
    )
    return tl.header_sections(headed, "p_partkey", "txt", ["NAME", "TYPE"])


def resolve_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Each exact copy of a text points to the copy before it."""
    documents = Tables(spark, folder)("documents")
    # A digest stands for the text, so texts are read once and never shuffled.
    prints = tl.materialize(documents.select("doc_id", F.sha2("text", 256).alias("print")))
    copies = OrderedGroups(prints, ["print"], ["doc_id"]).neighbour("before", F.col("doc_id"))
    aliases = copies.done().select("doc_id", F.col("before.v").alias("target"))
    resolved = tl.resolve_aliases(aliases, "doc_id", "target")
    return resolved.withColumnRenamed("root", "root_id")


def alias_hops(spark: SparkSession, folder: str) -> DataFrame:
    """From the latest order of every customer back to the first, order by order."""
    orders = Tables(spark, folder)("orders")
    chained = OrderedGroups(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    chained.neighbour("before", F.col("o_orderkey")).neighbour("next", F.col("o_orderkey"), before=False)
    aliases = tl.materialize(
        chained.done().select("o_orderkey", F.col("before.v").alias("target"), F.col("next").isNull().alias("newest"))
    )
    newest = aliases.where("newest").select("o_orderkey")
    return tl.alias_hops(aliases, "o_orderkey", "target", newest)


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    orders = Tables(spark, folder)("orders").withColumn("o_orderpriority", priority)
    return tl.column_profile(orders)


def table_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    year = F.year("o_orderdate")
    return tl.table_summary(
        {
            "orders": (t("orders"), year),
            "events": (t("events"), F.to_date("ts")),
            "lineitem": (t("lineitem"), None),
        }
    )


def sequence_profile(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    lines = tl.sequence_profile(t("lineitem"), "l_orderkey")
    return lines.unionByName(tl.sequence_profile(t("orders"), "o_orderkey"))


def filtered_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tl.filtered_counts(
        Tables(spark, folder)("lineitem"),
        {
            "f_returned": F.col("l_returnflag") == "R",
            "f_disc": (F.col("l_discount") > 0.05) & (F.col("l_quantity") < 24),
        },
    )


def presence_flags(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    flagged = tl.presence_flags(
        t("customer"),
        "c_custkey",
        {"has_orders": (t("orders"), "o_custkey"), "has_events": (t("events"), "user_id")},
    )
    return flagged.select("c_custkey", "has_orders", "has_events")


def first_match(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    price = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    found = tl.first_match(t("orders"), t("lineitem"), {"o_orderkey": "l_orderkey"}, price)
    return found.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def latest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The last error of the same user before each event."""
    events = Tables(spark, folder)("events")
    errors = events.where(F.col("event_type") == "error")
    found = tl.latest_match(
        events.select("event_id", "user_id", "ts"), errors, {"user_id": "user_id"}, ("ts", "ts"), ["event_id"],
        columns=["event_id", "ts", "value"], strict=True, prefix="error_",
    )
    return found.select("event_id", "error_event_id", "error_ts", "error_value")


def latest_match_after(spark: SparkSession, folder: str) -> DataFrame:
    """The first finished order of the customer from the day of each order on."""
    orders = Tables(spark, folder)("orders")
    finished = orders.where(F.col("o_orderstatus") == "F")
    found = tl.latest_match(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), finished, {"o_custkey": "o_custkey"},
        ("o_orderdate", "o_orderdate"), ["o_orderkey"], columns=["o_orderkey", "o_totalprice"], after=True, prefix="next_",
    )
    return found.select("o_orderkey", "next_o_orderkey", "next_o_totalprice")


KEY_CANDIDATES = [
    ["l_orderkey"],
    ["l_orderkey", "l_linenumber"],
    ["l_linenumber", "l_orderkey"],
    ["l_orderkey", "l_partkey"],
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    ["l_partkey", "l_suppkey"],
    ["l_suppkey", "l_shipdate"],
    ["l_returnflag", "l_linestatus"],
    ["l_partkey", "l_quantity", "l_discount"],
    ["l_orderkey", "l_suppkey", "l_extendedprice"],
    ["l_shipdate"],
]


def unique_sets_many(spark: SparkSession, folder: str) -> DataFrame:
    """Ten different column sets in one scan."""
    return tl.unique_sets(Tables(spark, folder)("lineitem"), KEY_CANDIDATES)


def unique_sets_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The same, where only sets that may be unique are counted exactly."""
    found = tl.unique_sets(Tables(spark, folder)("lineitem"), KEY_CANDIDATES, sketch=True)
    return found.select("cols", "n_rows", "is_unique")


def unique_sets(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    lines = tl.unique_sets(
        t("lineitem"),
        [["l_linenumber", "l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]],
    )
    turns = tl.unique_sets(t("conversations"), [["conv_id", "turn"], ["conv_id"]])
    return lines.unionByName(turns)


def fk_check(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    labelled = tl.fk_check(
        t("documents"), t("labels"), {"doc_id": "doc_id"}, "documents.doc_id->labels.doc_id"
    )
    parts = tl.fk_check(
        t("lineitem"),
        t("part"),
        {"l_partkey": "p_partkey"},
        "lineitem.l_partkey->part.p_partkey",
    )
    return labelled.unionByName(parts)


def fk_check_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Does every turn of a conversation but the first follow the one before it?"""
    turns = Tables(spark, folder)("conversations").select("conv_id", "turn")
    before = F.when(F.col("turn") > 0, F.col("turn") - 1)
    follows = turns.withColumn("before", before)
    return tl.fk_check(follows, turns, {"conv_id": "conv_id", "before": "turn"}, "turn->turn")


def relationship_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    blanked = F.when(F.col("l_discount") >= 0.01, F.col("l_partkey"))
    return tl.relationship_cardinality(
        [
            tl.Reference("orders", "customer", t("orders"), ["o_custkey"]),
            tl.Reference("labels", "documents", t("labels"), ["doc_id"]),
            tl.Reference(
                "lineitem", "part", t("lineitem").withColumn("l_partkey", blanked), ["l_partkey"]
            ),
        ]
    )


def build_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Which row refers to which: five references as one edge table."""
    t = Tables(spark, folder)

    def node(letter: str, column: str) -> F.Column:
        return F.concat(F.lit(letter), F.col(column))

    def edge(df: DataFrame, src: F.Column, dst: F.Column, flag: F.Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), flag.alias("flag"))

    no, yes = F.lit(False), F.lit(True)
    return tl.build_edges(
        [
            edge(
                t("orders"),
                node("O", "o_orderkey"),
                node("C", "o_custkey"),
                F.col("o_orderstatus") == "F",
            ),
            edge(t("customer"), node("C", "c_custkey"), node("N", "c_nationkey"), no),
            edge(t("supplier"), node("S", "s_suppkey"), node("N", "s_nationkey"), yes),
            edge(t("nation"), node("N", "n_nationkey"), node("R", "n_regionkey"), no),
            edge(
                t("lineitem"),
                node("L", "l_orderkey"),
                node("P", "l_partkey"),
                F.col("l_returnflag") == "R",
            ),
        ]
    )


def written_edges(spark: SparkSession, folder: str) -> DataFrame:
    return tl.materialize(build_edges(spark, folder), compression="zstd")


def edge_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return tl.edge_ordinals(written_edges(spark, folder).drop("flag"))


def nodes(spark: SparkSession, folder: str, *ends: tuple[str, str, str]) -> DataFrame:
    """All rows of some tables as nodes: the letter, table and key of each."""
    t = Tables(spark, folder)
    named = [t(table).select(F.concat(F.lit(letter), F.col(key)).alias("node")) for letter, table, key in ends]
    return reduce(DataFrame.unionByName, named)


REFERRED = [("R", "region", "r_regionkey"), ("N", "nation", "n_nationkey"), ("C", "customer", "c_custkey"), ("P", "part", "p_partkey")]
REFERRING = [
    ("O", "orders", "o_orderkey"), ("C", "customer", "c_custkey"), ("S", "supplier", "s_suppkey"),
    ("N", "nation", "n_nationkey"), ("L", "orders", "o_orderkey"),
]


def two_hop_in(spark: SparkSession, folder: str) -> DataFrame:
    """Who refers to every region, nation, customer and part, and who to them."""
    return tl.two_hop_in(written_edges(spark, folder), nodes(spark, folder, *REFERRED))


def two_hop_out(spark: SparkSession, folder: str) -> DataFrame:
    """What every order, its lines, customer, supplier and nation refer to, and what those do."""
    return tl.two_hop_out(written_edges(spark, folder), nodes(spark, folder, *REFERRING))


def two_hop_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Both ways from every customer, on edges stored by their ends."""
    edges = tl.store_edges(build_edges(spark, folder))
    customers = nodes(spark, folder, ("C", "customer", "c_custkey"))
    into = tl.two_hop_in(edges, customers).withColumn("way", F.lit("in"))
    return into.unionByName(tl.two_hop_out(edges, customers).withColumn("way", F.lit("out")))


def graph_layout_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """The surroundings of every customer and region, each hop with the sign of its reference."""
    t = Tables(spark, folder)
    references = [
        tl.Reference("O", "C", t("orders"), ["o_custkey"]),
        tl.Reference("C", "N", t("customer"), ["c_nationkey"]),
        tl.Reference("S", "N", t("supplier"), ["s_nationkey"]),
        tl.Reference("N", "R", t("nation"), ["n_regionkey"]),
        tl.Reference("L", "P", t("lineitem"), ["l_partkey"]),
    ]
    signs = tl.relationship_cardinality(references).select("child", "parent", F.col("label").alias("sign"))
    ends = {"child": F.substring("src", 1, 1), "parent": F.substring("dst", 1, 1)}
    edges = build_edges(spark, folder).withColumns(ends).join(signs, ["child", "parent"])
    focus = nodes(spark, folder, ("C", "customer", "c_custkey"), ("R", "region", "r_regionkey"))
    return tl.graph_layout(tl.materialize(edges.select("src", "dst", "sign")), focus, relations="sign")


def graph_layout_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The surroundings of every customer and nation, on edges stored by their ends."""
    focus = nodes(spark, folder, ("C", "customer", "c_custkey"), ("N", "nation", "n_nationkey"))
    return tl.graph_layout(tl.store_edges(build_edges(spark, folder)), focus)


def two_hop_focus(spark: SparkSession, folder: str) -> DataFrame:
    """The customers and suppliers of every nation, and their orders."""
    nations = Tables(spark, folder)("nation")
    focus = nations.select(F.concat(F.lit("N"), "n_nationkey").alias("node"))
    return tl.two_hop_in(written_edges(spark, folder), focus)


def graph_layout(spark: SparkSession, folder: str) -> DataFrame:
    return tl.graph_layout(written_edges(spark, folder))


def graph_layout_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The layout with the rows of each part and customer, and the flag of each edge."""
    t = Tables(spark, folder)
    lines = t("lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("node"))
    orders = t("orders").select(F.concat(F.lit("C"), "o_custkey").alias("node"))
    labels = lines.unionByName(orders).groupBy("node").agg(F.count("*").alias("n"))
    sign = F.when(F.col("flag"), "*").otherwise("")
    edges = written_edges(spark, folder).withColumn("sign", sign)
    return tl.graph_layout(edges, labels=labels, relations="sign")


def range_partition(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder)("orders")
    return tl.range_partition(orders, "o_orderdate", YEAR_STARTS).select("o_orderkey", "part_no")


def range_partition_many(spark: SparkSession, folder: str) -> DataFrame:
    """Five hundred ranges of the price, each closed above."""
    orders = Tables(spark, folder)("orders")
    steps = [1000.0 * i for i in range(1, 500)]
    parted = tl.range_partition(orders, "o_totalprice", steps, right=False)
    return parted.select("o_orderkey", "part_no")


def range_partition_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every part in the range of its size among the sizes of its own brand, with its label."""
    parts = Tables(spark, folder)("part")
    bounds = tl.materialize(size_bounds(spark, folder))
    parted = tl.range_partition_table(parts, "p_size", bounds, {"p_brand": "p_brand"}, "p_size")
    labels = tl.partition_labels(bounds, "p_brand", "n", "p_size", "p_size")
    return parted.join(labels, ["p_brand", "part_no"], "left").select("p_partkey", "p_brand", "part_no", "label")


def range_partition_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Every order among the prices of all pending orders of its priority, closed above."""
    orders = Tables(spark, folder)("orders")
    bounds = orders.where(F.col("o_orderstatus") == "P").select("o_orderpriority", "o_totalprice")
    on = {"o_orderpriority": "o_orderpriority"}
    parted = tl.range_partition_table(orders, "o_totalprice", bounds, on, "o_totalprice", right=False)
    return parted.select("o_orderkey", "part_no")


def storage_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and bytes of every range of every brand, ranges without parts included."""
    parts = Tables(spark, folder)("part")
    bounds = tl.materialize(size_bounds(spark, folder))
    parted = tl.range_partition_table(parts, "p_size", bounds, {"p_brand": "p_brand"}, "p_size")
    width = row_bytes(parts)
    stored = parted.groupBy("p_brand", "part_no").agg(F.count("*").alias("n_rows"), F.sum(width).alias("bytes"))
    labels = tl.partition_labels(bounds, "p_brand", "n", "p_size", "p_size")
    none = F.lit(0).cast("long")
    return labels.join(stored, ["p_brand", "part_no"], "left").select(
        "p_brand", "part_no", "label", F.coalesce("n_rows", none).alias("n_rows"), F.coalesce("bytes", none).alias("bytes")
    )


def block_storage(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each range of order dates, and its share of the stored bytes."""
    orders = Tables(spark, folder)("orders")
    parted = tl.range_partition(orders, "o_orderdate", YEAR_STARTS)
    stored = tl.block_storage(parted, "part_no")
    return stored.select("part_no", "n_rows", "n_files", F.round("stored_pct", 6).alias("stored_pct"))


def size_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every size of a brand's parts, numbered, as its boundaries."""
    sizes = Tables(spark, folder)("part").select("p_brand", "p_size").distinct()
    numbered = OrderedGroups(sizes, ["p_brand"], ["p_size"]).running({"n": F.lit(1)})
    return numbered.done()


def discrete_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return tl.discrete_boundaries(size_bounds(spark, folder), "p_brand", "p_size")


def partition_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes per brand, and the first order of each year per priority, as ranges."""
    sizes = tl.partition_labels(size_bounds(spark, folder), "p_brand", "n", "p_size", "size")
    orders = Tables(spark, folder)("orders")
    firsts = orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        F.date_trunc("day", F.min("o_orderdate")).alias("d")
    )
    days = OrderedGroups(firsts, ["o_orderpriority"], ["d"]).running({"n": F.lit(1)}).done()
    dates = tl.partition_labels(days, "o_orderpriority", "n", "d", "d", right=False)
    return sizes.withColumnRenamed("p_brand", "key").unionByName(
        dates.withColumnRenamed("o_orderpriority", "key")
    )


def partition_storage(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder)("orders")
    parted = tl.range_partition(orders, "o_orderdate", YEAR_STARTS)
    storage = tl.partition_storage(parted, "part_no")
    return storage.withColumns(
        {"avg_bytes": F.round("avg_bytes", 6), "pct": F.round("pct", 6)}
    )


def storage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Label, rows and bytes of each range of order dates, ranges without orders included."""
    orders = Tables(spark, folder)("orders")
    starts = [dt.datetime(1980, 1, 1), *YEAR_STARTS, dt.datetime(2090, 1, 1)]
    parted = tl.range_partition(orders, "o_orderdate", starts)
    storage = tl.partition_storage(parted, "part_no", ranges=len(starts) + 1)
    kind = orders.schema["o_orderdate"].dataType
    bounds = spark.createDataFrame(list(enumerate(map(str, starts), 1)), "n int, v string")
    bounds = bounds.select(F.lit("orders").alias("key"), "n", F.col("v").cast(kind).alias("v"))
    labels = tl.partition_labels(bounds, "key", "n", "v", "o_orderdate")
    report = labels.join(storage, "part_no").drop("key")
    return report.withColumns(
        {"avg_bytes": F.round("avg_bytes", 6), "pct": F.round("pct", 6)}
    )


def file_storage(spark: SparkSession, folder: str) -> DataFrame:
    return tl.file_storage(Tables(spark, folder)("orders"))


def state_pivot(spark: SparkSession, folder: str) -> DataFrame:
    # Sums of cents are exact, so they do not depend on the order of adding.
    price = F.col("o_totalprice").cast("decimal(18,2)")
    pivoted = tl.state_pivot(
        Tables(spark, folder)("orders"),
        [F.year("o_orderdate").cast("long").alias("y")],
        "o_orderstatus",
        {"O": "open", "F": "closed", "P": "pending"},
        {"n": (F.count, F.lit(1)), "amt": (F.sum, price)},
    )
    amounts = ["amt_open", "amt_closed", "amt_pending"]
    return pivoted.withColumns({a: F.col(a).cast("double") for a in amounts})


def runs(spark: SparkSession, folder: str) -> DataFrame:
    events = Tables(spark, folder)("events")
    return tl.runs(events, ["user_id"], ["ts", "event_id"], "event_type")


def run_lists(spark: SparkSession, folder: str) -> DataFrame:
    events = Tables(spark, folder)("events")
    hot = outgrown(events, ["user_id"])
    found = tl.runs(events, ["user_id"], ["ts", "event_id"], "event_type", hot=hot)
    # A user has no more runs than events: without hot users no list is hot either.
    return tl.run_lists(found, ["user_id"], "event_type", skip="view", hot=None if hot else [])


def ordered_list(spark: SparkSession, folder: str) -> DataFrame:
    return tl.ordered_list(
        Tables(spark, folder)("lineitem"),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        "l_partkey",
        suffix=F.when(F.col("l_returnflag") == "R", " DESC"),
        name="parts",
    )


def collapse_list(spark: SparkSession, folder: str) -> DataFrame:
    days = Tables(spark, folder)("events").withColumn("d", F.to_date("ts"))
    return tl.collapse_list(days, ["user_id", "d"], "event_type", name="types")


def scoped_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rules = spark.sql(
        """
        SELECT * FROM VALUES
            ('db', NULL, 'base'), ('region', 1, 'r1'), ('region', 2, 'r2'),
            ('nation', 3, 'n3'), ('nation', 8, 'n8'), ('customer', 42, 'c42')
        AS rules (scope, key, rule)
        """
    )
    nations = t("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customers = t("customer").join(nations, "c_nationkey", "left")
    scopes = {
        "db": None,
        "region": "n_regionkey",
        "nation": "c_nationkey",
        "customer": "c_custkey",
    }
    return tl.scoped_rules(rules, customers, "c_custkey", scopes)


def scoped_rules_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Rules stated by the tables at four scopes, listed per customer, state and option.

    A priority that the customer, a supplier of the nation or region, or anyone ordered at is
    the rule, and the state letter follows from the status of the order or the balance of the supplier.
    """
    t = Tables(spark, folder)
    letter = F.translate("o_orderstatus", "FOP", "DGW")
    owned = t("orders").select(F.lit("customer").alias("scope"), F.col("o_custkey").alias("key"), "o_orderpriority", letter.alias("state"))
    balance = F.when(F.col("s_acctbal") < 0, "D").when(F.col("s_acctbal") < 5000, "G").otherwise("W")
    supplied = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    flag = F.when(F.col("s_suppkey") % 2 == 0, "nation").otherwise("region")
    place = F.when(F.col("s_suppkey") % 2 == 0, F.col("n_nationkey")).otherwise(F.col("n_regionkey"))
    local = supplied.select(flag.alias("scope"), place.cast("long").alias("key"), F.concat(F.lit("S"), F.col("s_suppkey") % 7).alias("o_orderpriority"), balance.alias("state"))
    common = t("region").select(F.lit("db").alias("scope"), F.lit(None).cast("long").alias("key"), F.col("r_name"), F.lit("G").alias("state"))
    stated = owned.union(local).union(common).distinct().withColumn("s", tl.state_words(F.col("state")))
    rules = stated.select("scope", "key", F.col("o_orderpriority").alias("rule"), F.col("s.word").alias("word"), F.col("s.option").alias("option"))
    nations = t("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customers = t("customer").join(nations, "c_nationkey", "left")
    scopes = {"db": None, "region": "n_regionkey", "nation": "c_nationkey", "customer": "c_custkey"}
    return tl.scoped_rules(rules, customers, "c_custkey", scopes, by=["word", "option"])


def name_audit(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    names = (
        t("part")
        .select(F.col("p_name").alias("name"))
        .union(t("customer").select("c_mktsegment"))
        .union(t("orders").select("o_orderpriority"))
        .union(t("region").select("r_name"))
        .union(t("events").select("event_type"))
    )
    return tl.name_audit(names, "name", KEYWORDS)


def divided(query: Callable, rows: int) -> Callable[[SparkSession, str], DataFrame]:
    """The query with groups and join keys of more than ``rows`` rows divided, as a
    cluster divides them from a million rows on."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        before = spark.conf.get(HOT_GROUP_ROWS, None)
        spark.conf.set(HOT_GROUP_ROWS, str(rows))
        try:
            return query(spark, folder)
        finally:
            if before is None:
                spark.conf.unset(HOT_GROUP_ROWS)
            else:
                spark.conf.set(HOT_GROUP_ROWS, before)

    return run


QUERIES = {
    f.__name__: f
    for f in [
        like_any,
        like_any_literal,
        grep_lines,
        line_counts,
        search_union,
        add_containers,
        search_outline,
        search_report,
        text_preview,
        header_sections,
        resolve_aliases,
        alias_hops,
        column_profile,
        table_summary,
        sequence_profile,
        filtered_counts,
        presence_flags,
        first_match,
        latest_match,
        latest_match_after,
        unique_sets,
        unique_sets_many,
        unique_sets_sketched,
        fk_check,
        fk_check_composite,
        relationship_cardinality,
        build_edges,
        edge_ordinals,
        two_hop_in,
        two_hop_out,
        two_hop_focus,
        two_hop_stored,
        graph_layout,
        graph_layout_labels,
        graph_layout_cardinality,
        graph_layout_stored,
        range_partition,
        range_partition_many,
        range_partition_table,
        range_partition_prices,
        storage_by_key,
        discrete_boundaries,
        partition_labels,
        partition_storage,
        storage_report,
        file_storage,
        block_storage,
        state_pivot,
        runs,
        run_lists,
        ordered_list,
        collapse_list,
        scoped_rules,
        scoped_rules_by_state,
        name_audit,
    ]
} | {
    "runs_divided": divided(runs, 3),
    "ordered_list_divided": divided(ordered_list, 3),
    "two_hop_divided": divided(two_hop_in, 20),
    "latest_match_divided": divided(latest_match, 20),
    "range_partition_divided": divided(range_partition_prices, 1000),
}
