"""A table put in order once, by ranges, and looked at along that order.

The rows are cut into ranges of the keys and the order columns, so a large
group lies in several partitions. Numbering and sums run inside each partition;
what lies before comes from a table with one row per partition and group.
Nothing is sampled to decide which groups are large, and no list of them is
held: every group is treated the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.plans.tables import materialize

PART = "_part"


class Arranged:
    """``table`` is ``df`` with the column ``_part``, the number of the range of each
    row. Rows with the same keys and order values lie in one range, so the order
    should be total up to equal rows."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None) -> None:
        spark = df.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = keys, order
        ranged = df.repartitionByRange(n, *keys, *order)
        self.table = materialize(ranged.withColumn(PART, F.spark_partition_id()))

    def before(self, sums: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """The table with a column for each of ``sums``: the total over all earlier rows
        of the same keys, zero for the first."""
        own = Window.partitionBy(PART, *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        table = self.table if rows is None else rows
        totals = table.groupBy(PART, *self.keys).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            F.col(PART).alias("_carry_part"),
            *[F.col(k).alias(f"_carry_{k}") for k in self.keys],
            *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_carried_{n}") for n in sums],
        )
        within = table.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_within_{n}") for n, c in sums.items()])
        same = F.col(PART) == F.col("_carry_part")
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
        return within.join(carried, same).select(
            *[F.col(f"`{c}`") for c in table.columns if c != PART],
            *[(F.col(f"_within_{n}") + F.col(f"_carried_{n}")).alias(n) for n in sums],
        )
