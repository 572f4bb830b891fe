"""Wildcard search over text columns, and views of texts by line."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.patterns import contains_pattern, quote
from tablelens.functions.texts import (
    BLANK_LINE,
    as_list,
    grouped_digits,
    line_breaks,
    lines,
)
from tablelens.plans.groups import OrderedGroups, hot_groups
from tablelens.plans.joins import balanced_join

Pattern = str | Iterable[str]


def like_any(
    df: DataFrame, cols: str | Sequence[str], pattern: Pattern, case_sensitive: bool = False
) -> DataFrame:
    """Rows in which any of the columns contains the wildcard pattern.

    Several patterns mean any of them. A NULL column neither matches nor
    hinders the other columns.
    """
    found = contains_pattern(pattern, case_sensitive)
    return df.where(reduce(lambda a, b: a | b, [found(F.col(c)) for c in as_list(cols)]))


def grep_lines(
    df: DataFrame,
    id: str | Sequence[str],
    text: str,
    pattern: Pattern,
    case_sensitive: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per line that contains the pattern: ``(id, line, line_text, *keep)``.

    Lines count from 1 and a line is reported once, however often it matches.
    A pattern found in a line is found in the text as well, so whole texts are
    filtered first and only texts with a hit are split.
    """
    found = contains_pattern(pattern, case_sensitive)
    columns = [*as_list(id), *keep]
    return (
        df.where(found(F.col(text)))
        .select(*columns, F.posexplode(lines(F.col(text))).alias("_at", "line_text"))
        .where(found(F.col("line_text")))
        .select(
            *as_list(id), (F.col("_at") + 1).cast("long").alias("line"), "line_text", *keep
        )
    )


def line_counts(df: DataFrame, id: str | Sequence[str], text: str) -> DataFrame:
    """Number of line breaks of each text: ``(id, line_breaks)``."""
    return df.select(*as_list(id), line_breaks(F.col(text)).alias("line_breaks"))


@dataclass(frozen=True)
class Source:
    """A table to search. ``by_line`` reports hits per line, numbered as items;
    ``pattern`` replaces the common pattern for this table; ``shown`` is the
    reported text where it is not the first searched column."""

    name: str
    df: DataFrame
    parent_id: str
    texts: str | Sequence[str]
    item_no: str | None = None
    by_line: bool = False
    pattern: Pattern | None = None
    shown: str | None = None


def search_union(
    sources: Iterable[Source], pattern: Pattern, case_sensitive: bool = False
) -> DataFrame:
    """Hits of many tables in one schema: ``(src, parent_id, item_no, snippet)``."""

    def hits(s: Source) -> DataFrame:
        wanted = s.pattern if s.pattern is not None else pattern
        texts = as_list(s.texts)
        if s.by_line:
            found = [grep_lines(s.df, s.parent_id, t, wanted, case_sensitive) for t in texts]
            rows = reduce(DataFrame.unionByName, found)
            item, shown = F.col("line"), "line_text"
        else:
            rows = like_any(s.df, texts, wanted, case_sensitive)
            item = F.col(s.item_no) if s.item_no else F.lit(None)
            shown = s.shown or texts[0]
        return rows.select(
            F.lit(s.name).alias("src"),
            F.col(s.parent_id).alias("parent_id"),
            item.cast("long").alias("item_no"),
            F.col(shown).alias("snippet"),
        )

    return reduce(DataFrame.unionByName, [hits(s) for s in sources])


def add_containers(
    hits: DataFrame,
    child_key: str,
    parent_key: str | Sequence[str],
    kinds: tuple[str, str] = ("item", "container"),
) -> DataFrame:
    """The hits plus one row for each container that is not a hit itself.

    A hit without ``child_key`` is a hit on the container. The result is
    ``(kind, *parent_key, child_key)`` and all other columns of ``hits``, NULL in the rows
    added. ``hits`` is read twice; pass a materialized table when it is dear to
    compute. For several levels at once there is ``search_report``.
    """
    parents = as_list(parent_key)
    is_container = F.col(child_key).isNull()
    others = [c for c in hits.columns if c not in (*parents, child_key)]
    found = hits.select(
        F.when(is_container, kinds[1]).otherwise(kinds[0]).alias("kind"), *parents, child_key, *others
    )
    missing = (
        hits.groupBy(*parents)
        .agg(F.bool_or(is_container).alias("_is_hit"))
        .where(~F.col("_is_hit"))
        .select(
            F.lit(kinds[1]).alias("kind"),
            *parents,
            *[F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in (child_key, *others)],
        )
    )
    return found.unionByName(missing)


def search_outline(
    hits: DataFrame,
    group: str,
    item: str,
    detail: str,
    show: Sequence[str] = (),
    line_count: str | None = None,
    row_count: str | None = None,
    sort: bool = False,
) -> DataFrame:
    """Hits as an outline: a row per group, per item, then one per detail.

    A hit without ``detail`` is a hit on the item as a whole: it has the headers only.
    ``item_no`` numbers the items of a group and ``detail_no`` the details of an
    item, both 0 on header rows. ``mark`` names the item on its header row and
    draws a connector on details. ``size_label`` states the lines, else the
    rows, of the item, from columns of ``hits`` that are equal over an item.
    ``sort`` orders the report for display.
    """
    sizes = [c for c in (line_count, row_count) if c]
    columns = list(dict.fromkeys([group, item, detail, *show, *sizes]))
    hot = hot_groups(hits, [group, item])
    details = OrderedGroups(hits.select(*columns), [group, item], [detail], hot)
    has_detail = F.col(detail).isNotNull()
    details.running(
        {"detail_no": has_detail.cast("int"), "_hit": F.lit(1)}, totals={"detail_no": "_details"}
    )
    items = OrderedGroups(hits.select(group, item).distinct(), [group], [item])
    items.running({"item_no": F.lit(1)})
    # As a struct the key also joins where the group or the item is NULL.
    key = F.struct(group, item).alias("_key")
    hot_keys = [
        {"_key": {c: r[c] for c in (group, item)}, "_left": r["_rows"], "_right": 1} for r in hot
    ]
    numbered = balanced_join(
        details.done().select("*", key), items.done().select(key, "item_no"), ["_key"], hot=hot_keys
    )

    # The first hit of an item also yields the item's header row, and the
    # first item of a group the group's, so the headers need no second pass.
    first_hit = F.col("_hit") == 1
    levels = F.array_compact(
        F.array(
            F.when(has_detail, F.lit("detail")),
            F.when(first_hit, F.lit("item")),
            F.when(first_hit & (F.col("item_no") == 1), F.lit("group")),
        )
    )
    rows = numbered.withColumn("_level", F.explode(levels))
    is_detail, is_item = F.col("_level") == "detail", F.col("_level") == "item"
    not_group = F.col("_level") != "group"

    last = F.col("detail_no") == F.col("_details")
    connector = F.when((F.col("detail_no") == 1) & ~last, "/").when(last, "\\").otherwise("|")
    mark = (
        F.when(is_detail, connector)
        .when(is_item, F.concat_ws(".", F.col(group), F.col(item).cast("string")))
        .otherwise("")
    )
    labels: list[Column] = []
    if line_count:
        labels.append(F.concat(grouped_digits(F.col(line_count)), F.lit(" lines")))
    if row_count:
        labels.append(F.concat(grouped_digits(F.col(row_count)), F.lit(" rows")))
    outline = rows.select(
        group,
        F.when(not_group, F.col("item_no")).otherwise(0).alias("item_no"),
        F.when(is_detail, F.col("detail_no")).otherwise(0).alias("detail_no"),
        mark.alias("mark"),
        F.when(is_item, F.coalesce(*labels, F.lit(""))).otherwise("").alias("size_label"),
        *[F.when(is_detail, F.col(c)).alias(c) for c in dict.fromkeys([detail, *show])],
    )
    return outline.orderBy(group, "item_no", "detail_no") if sort else outline


def text_preview(
    df: DataFrame, id: str | Sequence[str], text: str, max_lines: int = 31
) -> DataFrame:
    """The lines from the first non-blank one up to line ``max_lines``.

    The result is ``(id, line, line_text, truncated)``; ``truncated`` tells
    that a non-blank line comes later, found in the whole rest of the text. Lines
    of spaces are blank. A line break at the very end adds no empty last line.
    """
    # Through a generator the split becomes a column that is computed once.
    once = F.inline(F.array(F.struct(lines(F.col(text), max_lines + 1).alias("_parts"))))
    rest = F.get("_parts", F.lit(max_lines))
    shown = (
        df.select(*as_list(id), once)
        .select(
            *as_list(id),
            F.slice("_parts", 1, max_lines).alias("_head"),
            F.coalesce(rest.rlike("[^ \r\n]"), F.lit(False)).alias("truncated"),
            F.when(F.size("_parts") <= max_lines, F.size("_parts")).alias("_last"),
        )
        .withColumn(
            "_first",
            F.array_position(F.transform("_head", lambda line: F.trim(line) != ""), F.lit(True)),
        )
        .where(F.col("_first") > 0)
        .select(
            *as_list(id),
            "truncated",
            "_first",
            "_last",
            F.posexplode("_head").alias("_at", "line_text"),
        )
    )
    line = F.col("_at") + 1
    ends_blank = (line == F.col("_last")) & (F.col("line_text") == "")
    return shown.where((line >= F.col("_first")) & ~F.coalesce(ends_blank, F.lit(False))).select(
        *as_list(id), line.cast("long").alias("line"), "line_text", "truncated"
    )


def header_sections(
    df: DataFrame, id: str | Sequence[str], text: str, keys: Sequence[str]
) -> DataFrame:
    """For each key, what follows ``KEY:`` up to the next blank line, or the end.

    Runs of blanks and line breaks become one space. Columns are named
    ``<key>_text`` in lower case; a text without the key has NULL there.
    """

    def section(key: str) -> Column:
        regex = f"(?s){quote(key)}:(.*?)(?:{BLANK_LINE}|\\z)"
        body = F.regexp_replace(F.regexp_extract(text, regex, 1), "\\s+", " ")
        found = F.contains(F.col(text), F.lit(f"{key}:"))
        return F.when(found, F.trim(body)).alias(f"{key.lower()}_text")

    return df.select(*as_list(id), *[section(k) for k in keys])
