"""Runs of equal values in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.lists import PIECE_ITEMS, ordered_list
from tablelens.plans.groups import Hot, OrderedGroups


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    hot: list[Hot] | None = None,
) -> DataFrame:
    """Consecutive equal values per key.

    ``(*keys, run_no, value, first_n, last_n, len, key_len)``: rows are
    numbered from 1 in the total ``order``, a run spans ``first_n`` to
    ``last_n``, and ``key_len`` is the number of rows of the key. NULL is a
    value like any other. The group shuffle serves numbering and aggregation
    alike; a hot key is cut into chunks whose runs join up at the borders.
    ``hot`` passes the hot keys in when they are known.
    """
    columns = list(dict.fromkeys([*keys, *order, value]))
    rows = OrderedGroups(df.select(*columns), keys, order, hot)
    rows = rows.neighbour("_before", F.col(value))
    same = F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(value))
    numbered = rows.running(
        {"_n": F.lit(1), "run_no": F.when(same, 0).otherwise(1)}, totals={"_n": "key_len"}
    ).done()
    return (
        numbered.groupBy(*keys, "run_no", value, "key_len")
        .agg(
            F.min("_n").alias("first_n"),
            F.max("_n").alias("last_n"),
            F.count("*").alias("len"),
        )
        .select(*keys, "run_no", value, "first_n", "last_n", "len", "key_len")
    )


def run_lists(
    runs: DataFrame,
    keys: Sequence[str],
    value: str,
    skip: object | None = None,
    piece_items: int = PIECE_ITEMS,
    hot: list[Hot] | None = None,
) -> DataFrame:
    """The runs of each value as text, such as ``1 TO 3, 7``, in ``runs``.

    A run that covers its whole key reads ``ALL``. One value may be skipped.
    The input is the result of ``runs``; see ``ordered_list`` for ``piece``.
    """
    wanted = runs if skip is None else runs.where(~F.col(value).eqNullSafe(F.lit(skip)))
    several = F.concat(F.col("first_n").cast("string"), F.lit(" TO "), F.col("last_n"))
    text = (
        F.when(F.col("len") == F.col("key_len"), "ALL")
        .when(F.col("last_n") > F.col("first_n"), several)
        .otherwise(F.col("first_n").cast("string"))
    )
    return ordered_list(
        wanted.withColumn("_text", text),
        [*keys, value],
        ["run_no"],
        "_text",
        name="runs",
        piece_items=piece_items,
        hot=hot,
    )
