"""Lists of items per key, as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.plans.groups import Hot, OrderedGroups
from tablelens.plans.tables import materialize

PIECE_ITEMS = 10_000


def ordered_list(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: str,
    suffix: Column | None = None,
    name: str = "list",
    piece_items: int = PIECE_ITEMS,
    hot: list[Hot] | bool | None = None,
) -> DataFrame:
    """Per key the items in the total ``order``, joined by ``", "``.

    The result is ``(*keys, piece, name)``. A text of unlimited length cannot
    be one value, so a list longer than ``piece_items`` goes on in further
    rows: piece 0, 1, 2 and so on hold the whole list between them. ``suffix``
    is added to an item where it is not NULL. ``hot`` passes the hot keys in
    when they are known.
    """
    text = F.col(item).cast("string")
    if suffix is not None:
        text = F.concat(text, F.coalesce(suffix, F.lit("")))
    columns = list(dict.fromkeys([*keys, *order]))
    numbered = (
        OrderedGroups(df.select(*columns, text.alias("_item")), keys, order, hot)
        .running({"_n": F.lit(1)})
        .done()
    )
    return _join_items(numbered, keys, name, piece_items)


def _join_items(
    numbered: DataFrame, by: Sequence[str], name: str, piece_items: int
) -> DataFrame:
    """Items numbered by ``_n`` joined into pieces. The numbering has already
    brought each key together, so the pieces need no shuffle of their own
    unless a hot key was cut."""
    return (
        numbered.withColumn("piece", F.expr(f"(_n - 1) div {piece_items}"))
        .groupBy(*by, "piece")
        .agg(F.expr("listagg(_item, ', ') WITHIN GROUP (ORDER BY _n)").alias(name))
    )


def collapse_list(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    full: Sequence[object] | None = None,
    name: str = "list",
    all_label: str = "ALL",
    piece_items: int = PIECE_ITEMS,
) -> DataFrame:
    """Per key the sorted distinct items, or ``ALL`` when they are the full set.

    ``full`` lists the full set; unless given it is every item of the table.
    Repeated items are dropped before the shuffle and the pairs of key and item are written,
    as the size of the groups, the full set and the lists are all asked of them. The
    result is ``(*keys, piece, name)`` as in ``ordered_list``.
    """
    pairs = materialize(df.select(*keys, item).where(F.col(item).isNotNull()).distinct())
    if full is None:
        belongs = F.lit(1)
        size = pairs.agg(F.count_distinct(item)).scalar()
    else:
        belongs = F.col(item).isin(list(full)).cast("int")
        size = F.lit(len(set(full)))
    numbered = (
        OrderedGroups(pairs, keys, [item])
        .running({"_n": F.lit(1), "_in": belongs}, totals={"_n": "_items", "_in": "_members"})
        .done()
        .withColumn("_item", F.col(item).cast("string"))
        .withColumn("_all", (F.col("_items") == size) & (F.col("_members") == size))
    )
    lists = _join_items(numbered, [*keys, "_all"], name, piece_items)
    return lists.where(~F.col("_all") | (F.col("piece") == 0)).select(
        *keys, "piece", F.when(F.col("_all"), all_label).otherwise(F.col(name)).alias(name)
    )
