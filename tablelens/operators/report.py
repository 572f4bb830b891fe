"""Hits of a search rolled up to what contains them, as one report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.texts import grouped_digits
from tablelens.plans.groups import OrderedGroups


def search_report(
    hits: DataFrame,
    levels: Sequence[str],
    text: str | None = None,
    attributes: Mapping[str, Sequence[str]] | None = None,
    line_count: str | None = None,
    row_count: str | None = None,
    sort: bool = False,
) -> DataFrame:
    """A row for every group, container and item that has hits, headers above details.

    ``levels`` names the columns of ``hits`` from the outermost to the innermost. A hit whose
    value is NULL from some level on is a hit on what is above as a whole: it makes that header a hit and no row of its
    own. (NULL at the first level is a group like others.) The result is

    ``(level, *levels, n_hits, is_hit, ordinal, siblings, mark, size_label, text, *attributes)``

    ``level`` counts from 1; deeper level columns are NULL on a header. ``n_hits`` are the hits
    on the row and all below it, ``is_hit`` tells whether it was hit itself and ``text`` is
    the least text of those hits. ``ordinal`` numbers a row among its ``siblings``, in order of
    their values. ``mark`` is the dotted name on headers below the first level and a connector on
    the innermost. ``attributes`` maps a level to columns of ``hits``
    that are shown on its rows and NULL elsewhere, such as a description; ``line_count`` and
    ``row_count`` are columns shown, lines first, as ``size_label`` of the level above the innermost. Such
    columns should be equal over a row of the report; the largest counts if not. ``sort``
    orders the report for display.

    All levels come from one aggregation with ROLLUP, reduced before the shuffle. Without hits
    there are no rows.
    """
    levels, attributes = list(levels), dict(attributes or {})
    depth = len(levels)
    shown = list(dict.fromkeys(c for cols in attributes.values() for c in cols))
    sizes = [c for c in (line_count, row_count) if c]

    # A value below a NULL belongs to nothing, so it goes as well.
    whole = [F.lit(True)]
    for c in levels[1:]:
        whole.append(whole[-1] & F.col(c).isNotNull())
    reached = reduce(lambda a, b: a + b, [w.cast("int") for w in whole])
    cut = hits.select(
        *[F.when(w, F.col(c)).alias(c) for w, c in zip(whole, levels, strict=True)],
        reached.alias("_reached"),
        (F.col(text) if text else F.lit(None).cast("string")).alias("_text"),
        *[F.col(c).alias(f"_a_{c}") for c in dict.fromkeys([*shown, *sizes])],
    )
    own = [F.col("_reached") == i for i in range(1, depth + 1)]
    rolled = cut.rollup(*levels).agg(
        F.grouping_id().alias("_id"),
        F.count("*").alias("n_hits"),
        F.array(*[F.count_if(o) > 0 for o in own]).alias("_own"),
        F.array(*[F.min(F.when(o, F.col("_text"))) for o in own]).alias("_texts"),
        *[F.max(f"_a_{c}").alias(f"_a_{c}") for c in dict.fromkeys([*shown, *sizes])],
    )
    # Of k levels, the row of level i has the last k - i rolled up: ones in its id.
    level = (F.lit(depth) - F.bit_count("_id")).cast("int")
    rows = rolled.withColumn("level", level).where(F.col("level") > 0)
    last_value = F.coalesce(*[F.when((F.col("level") == i) & F.col(c).isNotNull(), True) for i, c in enumerate(levels, 1) if i > 1], F.col("level") == 1)
    rows = rows.where(last_value)

    above = F.struct(*[F.when(F.col("level") > i, F.col(c)).alias(f"k{i}") for i, c in enumerate(levels, 1)])
    numbered = OrderedGroups(rows.withColumn("_above", above), ["level", "_above"], levels)
    numbered.running({"ordinal": F.lit(1)}, totals={"ordinal": "siblings"})

    is_last = F.col("ordinal") == F.col("siblings")
    connector = F.when((F.col("ordinal") == 1) & ~is_last, "/").when(is_last, "\\").otherwise("|")
    names = [F.col(c).cast("string") for c in levels]
    mark: Column = F.when(F.col("level") == 1, "" if depth > 1 else connector)
    for i in range(2, depth):
        mark = mark.when(F.col("level") == i, F.concat_ws(".", *names[:i]))
    labels = [
        F.concat(grouped_digits(F.col(f"_a_{c}")), F.lit(f" {unit}"))
        for c, unit in ((line_count, "lines"), (row_count, "rows"))
        if c
    ]
    sized = F.when(F.col("level") == max(1, depth - 1), F.coalesce(*labels, F.lit("")))
    report = numbered.done().select(
        "level",
        *levels,
        "n_hits",
        F.get("_own", F.col("level") - 1).alias("is_hit"),
        "ordinal",
        "siblings",
        mark.otherwise(connector).alias("mark"),
        F.coalesce(sized, F.lit("")).alias("size_label"),
        F.get("_texts", F.col("level") - 1).alias("text"),
        *[
            F.when(F.col("level").isin([levels.index(n) + 1 for n, cols in attributes.items() if c in cols]), F.col(f"_a_{c}")).alias(c)
            for c in shown
        ],
    )
    return report.orderBy(*levels) if sort else report
