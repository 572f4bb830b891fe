"""Ordered work inside groups when one group may hold much of the table.

A window puts a whole group into one task. That is the right plan until a
group outgrows a task, so the largest group is estimated first, from a sample of
the key columns. When every group fits, the operators here are plain windows. When
one does not, the table is put in order once by ranges of its keys and order
columns, so a large group lies in several ranges: rows are numbered inside
their range, and a small table carries the sums of the ranges before it. No
list of large groups is held; every group is treated the same.

Samples only decide between the two plans and where ranges begin, as in any range
partitioning. Every row takes part in the result and every result is exact.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.plans.arranged import PART, Arranged

HOT_GROUP_ROWS = "tablelens.hotGroupRows"
DEFAULT_HOT_GROUP_ROWS = 1_000_000
# What a list of hot keys may weigh, on the driver and in a broadcast.
HOT_LIST_BYTES = 32 << 20
# Sampled rows by which a group of just the hot size is noticed.
SAMPLES_PER_HOT_GROUP = 1_000

# The keys of a hot group or join key with its numbers of rows.
Hot = dict[str, Any]


def hot_group_rows(spark: SparkSession) -> int:
    """Rows one group may put into one task (session setting, default one million)."""
    return int(spark.conf.get(HOT_GROUP_ROWS, str(DEFAULT_HOT_GROUP_ROWS)))


def sample_rate(spark: SparkSession) -> float:
    """The share of rows by which hot groups are looked for; all for a small hot size."""
    return min(1.0, SAMPLES_PER_HOT_GROUP / hot_group_rows(spark))


def sampled(df: DataFrame) -> DataFrame:
    rate = sample_rate(df.sparkSession)
    return df if rate == 1.0 else df.sample(rate, seed=1)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rate = sample_rate(df.sparkSession)
    counted = sampled(df.select(*keys)).groupBy(*keys)
    return counted.agg((F.count("*") / rate).cast("long").alias("_rows"))


def hot_groups(df: DataFrame, keys: Sequence[str]) -> list[Hot]:
    """The groups too large for one task, each with its estimated ``_rows``."""
    return bounded(group_sizes(df, keys), keys, F.col("_rows"))


def outgrown(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a group is too large for one task, by the estimated sizes."""
    most = group_sizes(df, keys).agg(F.max("_rows")).first()[0]
    return (most or 0) > hot_group_rows(df.sparkSession)


def bounded(counted: DataFrame, keys: Sequence[str], rows: Column) -> list[Hot]:
    """The keys with more rows than one task takes. Should their list outgrow its
    bytes, larger keys only: the others are left to the skewed join of adaptive
    execution, which the log tells."""
    bar = hot_group_rows(counted.sparkSession)
    weight = F.octet_length(F.to_json(F.struct(*keys))) + F.lit(16)
    while True:
        hot = counted.where(rows > bar)
        n_bytes, most = hot.agg(F.sum(weight), F.max(rows)).first()
        if not n_bytes:
            return []
        if n_bytes <= HOT_LIST_BYTES:
            return fetched(hot)
        logging.getLogger(__name__).warning("keys of up to %d rows are left to adaptive execution", 2 * bar)
        if most <= 2 * bar:  # keys alike in size: as many of them as fit
            lot = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
            return fetched(hot.where(lot < int(HOT_LIST_BYTES / n_bytes * (1 << 20))))
        bar *= 2


def fetched(small: DataFrame) -> list[Hot]:
    """A few bounded rows on the driver; Arrow keeps every value exact."""
    return small.toArrow().to_pylist()


def local_table(spark: SparkSession, rows: list[Hot], schema: T.StructType) -> DataFrame:
    """A few bounded rows as a table whose size the optimizer knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows), schema)


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Null-safe broadcast join with a table of proven size: a list of hot keys, bounded
    in bytes, or at most two rows per range."""
    names = {k: f"_small_{i}" for i, k in enumerate(on)}
    small = small.withColumnsRenamed(names)
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    )
    return df.join(F.broadcast(small), same, how).drop(*names.values())


def position(sorted_values: Column, value: Column, steps: int, strict: bool = False) -> Column:
    """How many of the sorted values are ``<= value`` (``< value`` if strict), by halving.

    ``steps`` is the bit length of the longest array.
    """
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])

    def jump(found: Column, stride: Column) -> Column:
        at = F.get(sorted_values, found + stride - 1)
        return F.when(at < value if strict else at <= value, found + stride).otherwise(found)

    return F.aggregate(strides, F.lit(0), jump)


class OrderedGroups:
    """Rows of ``df`` grouped by ``keys`` in ``order`` (ascending, NULLs first).

    The order must be total within a group for results to be determined.
    ``hot`` tells whether there are hot groups when that is already known.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot: list[Hot] | bool | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        self.is_split = outgrown(df, self.keys) if hot is None else bool(hot)
        self.rows = Arranged(df, self.keys, self.order).table if self.is_split else df
        self.by = [*self.keys, PART] if self.is_split else self.keys
        self.window = Window.partitionBy(*self.by).orderBy(*self.order)

    def running(
        self, sums: Mapping[str, Column], totals: Mapping[str, str] | None = None
    ) -> OrderedGroups:
        """Add running sums over the group, and group totals under the names in ``totals``."""
        totals = dict(totals or {})
        so_far = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        group = Window.partitionBy(*self.by)
        if not self.is_split:
            self.rows = self.rows.withColumns(
                {n: F.sum(v).over(so_far) for n, v in sums.items()}
                | {totals[n]: F.sum(sums[n]).over(group) for n in totals}
            )
            return self
        chunks = self._chunks([F.sum(v).alias(n) for n, v in sums.items()])
        order = Window.partitionBy(*self.keys).orderBy(PART)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        carried = chunks.select(
            *self.by,
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
            *[F.sum(n).over(Window.partitionBy(*self.keys)).alias(f"_all_{n}") for n in totals],
        )
        rows = join_small(self.rows, carried, self.by, "left")
        rows = rows.withColumns(
            {
                n: F.sum(v).over(so_far) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))
                for n, v in sums.items()
            }
            | {
                totals[n]: F.coalesce(F.col(f"_all_{n}"), F.sum(sums[n]).over(group))
                for n in totals
            }
        )
        self.rows = rows.drop(*[f"_before_{n}" for n in sums], *[f"_all_{n}" for n in totals])
        return self

    def neighbour(self, name: str, value: Column, before: bool = True) -> OrderedGroups:
        """Add ``name``, a struct ``(v)`` with the value of the row before (or
        after) in the group; the struct is NULL where there is no such row."""
        boxed = F.struct(value.alias("v"))
        step = F.lag if before else F.lead
        inside = step(boxed).over(self.window)
        if not self.is_split:
            self.rows = self.rows.withColumn(name, inside)
            return self
        edge = F.max_by if before else F.min_by
        chunks = self._chunks([edge(boxed, F.struct(*self.order)).alias("_edge")])
        order = Window.partitionBy(*self.keys).orderBy(PART)
        carried = chunks.select(*self.by, step("_edge").over(order).alias("_carried"))
        rows = join_small(self.rows, carried, self.by, "left")
        self.rows = rows.withColumn(name, F.coalesce(inside, F.col("_carried"))).drop("_carried")
        return self

    def latest(self, name: str, value: Column, before: bool = True) -> OrderedGroups:
        """Add ``name``, the last value of the group up to the row that is not NULL (or the
        first from the row on); NULL where there is none."""
        pick, edge = (F.last, F.max_by) if before else (F.first, F.min_by)
        ends = (Window.unboundedPreceding, Window.currentRow) if before else (Window.currentRow, Window.unboundedFollowing)
        inside = pick(value, ignorenulls=True).over(self.window.rowsBetween(*ends))
        if not self.is_split:
            self.rows = self.rows.withColumn(name, inside)
            return self
        place = F.when(value.isNotNull(), F.struct(*self.order))
        chunks = self._chunks([edge(value, place).alias("_edge")])
        others = (Window.unboundedPreceding, -1) if before else (1, Window.unboundedFollowing)
        order = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(*others)
        carried = chunks.select(*self.by, pick("_edge", ignorenulls=True).over(order).alias("_carried"))
        rows = join_small(self.rows, carried, self.by, "left")
        self.rows = rows.withColumn(name, F.coalesce(inside, F.col("_carried"))).drop("_carried")
        return self

    def done(self) -> DataFrame:
        return self.rows.drop(PART)

    def _chunks(self, measures: list[Column]) -> DataFrame:
        """One row per range of a group that lies in several: at most two per range,
        as all groups in it but the first and the last are whole."""
        chunks = self.rows.groupBy(*self.by).agg(*measures)
        ranges = F.count("*").over(Window.partitionBy(*self.keys))
        return chunks.withColumn("_ranges", ranges).where("_ranges > 1").drop("_ranges")
