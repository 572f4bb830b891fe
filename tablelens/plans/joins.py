"""Equi-joins that spread hot keys over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.plans.groups import (
    Hot,
    bounded,
    hot_group_rows,
    join_small,
    local_table,
    sample_rate,
    sampled,
)


def hot_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str], right_unique: bool = False
) -> list[Hot]:
    """Join keys that are hot on either side, with estimated ``_left`` and ``_right`` rows."""
    rate = sample_rate(left.sparkSession)

    def rows(df: DataFrame, is_left: int) -> DataFrame:
        return sampled(df.select(*on)).select(
            *on, F.lit(is_left).alias("_left"), F.lit(1 - is_left).alias("_right")
        )

    counted = rows(left, 1)
    if not right_unique:
        counted = counted.unionByName(rows(right, 0))
    sizes = counted.groupBy(*on).agg(
        (F.sum("_left") / rate).cast("long").alias("_left"),
        (F.sum("_right") / rate).cast("long").alias("_right"),
    )
    return bounded(sizes, on, F.greatest("_left", "_right"))


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    right_unique: bool = False,
    hot: list[Hot] | None = None,
) -> DataFrame:
    """Inner or left join on equally named columns, exact under any skew.

    Without hot keys it is the ordinary join and the optimizer picks its kind.
    The rows of a hot key are dealt out over ``a`` parts on the left and ``b``
    on the right; each side is repeated over the parts of the other, so every
    pair of rows meets in exactly one of the ``a * b`` tasks. The other columns
    decide the part of a row, so pass tables whole: columns that are not needed
    later are pruned where no key is hot.
    """
    on = list(on)
    if hot is None:
        hot = hot_keys(left, right, on, right_unique)
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    size = hot_group_rows(spark)
    parts = [
        {k: r[k] for k in on}
        | {"_a": max(1, math.ceil(r["_left"] / size)), "_b": max(1, math.ceil(r["_right"] / size))}
        for r in hot
    ]
    schema = left.select(*on).schema.add("_a", T.IntegerType()).add("_b", T.IntegerType())
    small = local_table(spark, parts, schema)
    one = F.lit(1)

    def spread(df: DataFrame, dealt: str, repeated: str, n: str, m: str) -> DataFrame:
        # The part follows from the row's content, so a repeated task deals alike.
        lot = F.xxhash64(*[c for c in df.columns if c not in on] or on)
        return (
            join_small(df, small, on, "left")
            .withColumn(dealt, F.pmod(lot, F.coalesce(F.col(n), one)).cast("int"))
            .withColumn(repeated, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(m), one) - 1)))
        )

    rows = spread(left, "_i", "_j", "_a", "_b").drop("_a")
    other = spread(right, "_j", "_i", "_b", "_a").drop("_a", "_b").withColumn("_met", F.lit(True))
    joined = rows.join(other, [*on, "_i", "_j"], how)
    if how == "left":
        # A key cut on the right has matches; a part of it without any is no miss.
        cut = F.coalesce(F.col("_b") > 1, F.lit(False))
        joined = joined.where(~(cut & F.col("_met").isNull()))
    return joined.drop("_i", "_j", "_b", "_met")
