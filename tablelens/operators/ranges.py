"""Range partitions over a column, their labels and their storage."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.widths import row_bytes
from tablelens.plans.groups import OrderedGroups, position
from tablelens.plans.joins import balanced_join
from tablelens.plans.tables import materialize

# Up to here a chain of comparisons, compiled with the scan, beats halving.
FEW_BOUNDS = 32
# Boundaries of one bucket, held in one array.
BUCKET_BOUNDS = 1024


def range_partition(
    df: DataFrame,
    col: str,
    boundaries: Sequence[object],
    right: bool = True,
    name: str = "part_no",
) -> DataFrame:
    """``df`` with the number of the range each row falls in.

    N sorted boundaries make N+1 ranges, counted from 1. With ``right`` a
    value equal to a boundary belongs above it, otherwise below. NULL belongs
    to range 1. No shuffle: the boundaries are part of the expression.
    """
    data_type = df.schema[col].dataType
    # All go in as text: no time zone can shift a time, and many need one call.
    texts = [b.isoformat(" ") if isinstance(b, dt.datetime) else str(b) for b in sorted(boundaries)]
    value = F.col(col)
    if len(texts) <= FEW_BOUNDS:
        bounds = [F.lit(t).cast(data_type) for t in texts]
        passed = [(b <= value) if right else (b < value) for b in bounds]
        above = reduce(lambda a, b: a + b, [p.cast("long") for p in passed], F.lit(0).cast("long"))
    else:
        listed = F.from_json(F.lit(json.dumps(texts)), "array<string>")
        bounds = listed.cast(T.ArrayType(data_type))
        above = position(bounds, value, len(texts).bit_length(), strict=not right)
    return df.withColumn(name, F.lit(1).cast("long") + F.coalesce(above, F.lit(0)).cast("long"))


def range_partition_table(
    df: DataFrame,
    col: str,
    bounds: DataFrame,
    on: Mapping[str, str],
    boundary: str = "boundary",
    right: bool = True,
    name: str = "part_no",
) -> DataFrame:
    """``df`` with the number of the range each row falls in, by a table of boundaries.

    ``bounds`` holds the boundaries of every key, one to a row, in any number; ``on`` maps
    the key columns of ``df`` to its own (NULL is a key like others). A range is
    numbered by the boundaries of its key below it, from 1, as in ``range_partition``:
    NULL values, and rows of a key without boundaries, belong to range 1. NULL boundaries
    count for nothing, repeated ones each time.

    The boundaries of a key become buckets of at most 1,024 in an array, and the first ones
    of its buckets are boundaries of a level above, until one bucket per key is left. A
    row goes down the levels, one equi-join on key and bucket each, and finds its place in
    an array by halving. A level that is small is broadcast, as its size is known; in a
    large one hot keys are dealt out.
    """
    kind = df.schema[col].dataType
    keys = [F.col(b).cast(df.schema[c].dataType).alias(f"k{i}") for i, (c, b) in enumerate(on.items())]
    known = bounds.where(F.col(boundary).isNotNull()).select(
        F.struct(*keys).alias("_key"), F.col(boundary).cast(kind).alias("_bound")
    )
    level = materialize(OrderedGroups(known, ["_key"], ["_bound"]).running({"_n": F.lit(1)}).done())
    bucket = F.expr(f"(_n - 1) div {BUCKET_BOUNDS}").alias("_bucket")
    levels = []
    while True:
        by_key = level.groupBy("_key", bucket).agg(F.array_sort(F.collect_list("_bound")).alias("_bounds"))
        levels.append(materialize(by_key))
        if (level.agg(F.max("_n")).first()[0] or 0) <= BUCKET_BOUNDS:
            break
        level = level.where((F.col("_n") - 1) % BUCKET_BOUNDS == 0).select("_key", "_bound", (bucket + 1).alias("_n"))

    own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    rows = df.withColumns({"_key": own, "_bucket": F.lit(0).cast("long")})
    passed = position(F.col("_bounds"), F.col(col), BUCKET_BOUNDS.bit_length(), strict=not right)
    for below, at in reversed(list(enumerate(levels))):
        found = balanced_join(rows, at, ["_key", "_bucket"], "left", right_unique=True)
        count = F.col("_bucket") * BUCKET_BOUNDS + F.coalesce(passed, F.lit(0))
        # Above the last level the count is that of buckets that begin up to the value;
        # without any, the first bucket is looked at and passes none.
        next_bucket = count if below == 0 else F.greatest(count - 1, F.lit(0))
        rows = found.withColumn("_bucket", next_bucket.cast("long")).drop("_bounds")
    return rows.withColumn(name, F.col("_bucket") + 1).select(*[c for c in df.columns if c != name], name)


def discrete_boundaries(bounds: DataFrame, key: str, boundary: str = "boundary") -> DataFrame:
    """``bounds`` with ``is_discrete``: do its neighbours lie exactly one step away?

    A step is 1 for integers, a day for dates and false to true for booleans; other
    types are never discrete. The boundary before must exist, the one after need not.
    """
    data_type = bounds.schema[boundary].dataType
    here = F.col(boundary)
    if isinstance(data_type, T.IntegralType):
        at = here.cast("decimal(20,0)")
        follows: Callable[[Column, Column], Column] = lambda a, b: a + 1 == b
    elif isinstance(data_type, T.BooleanType):
        at = here.cast("int")
        follows = lambda a, b: a + 1 == b
    elif isinstance(data_type, T.DateType):
        at = here
        follows = lambda a, b: F.date_add(a, 1) == b
    else:
        return bounds.withColumn("is_discrete", F.lit(False))
    near = (
        OrderedGroups(bounds, [key], [boundary])
        .neighbour("_before", at)
        .neighbour("_after", at, before=False)
        .done()
    )
    before, after = F.col("_before.v"), F.col("_after.v")
    flag = follows(before, at) & F.coalesce(follows(at, after), F.lit(True))
    return near.withColumn("is_discrete", F.coalesce(flag, F.lit(False))).drop("_before", "_after")


def boundary_text(value: Column, data_type: T.DataType) -> Column:
    """A boundary as text; timestamps at midnight show the date alone."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        day = F.date_format(value, "yyyy-MM-dd")
        is_day = value == F.date_trunc("day", value)
        return F.when(is_day, day).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))
    return value.cast("string")


def partition_labels(
    bounds: DataFrame, key: str, n: str, boundary: str, col: str, right: bool = True
) -> DataFrame:
    """A readable range per partition: ``(key, part_no, label)``.

    ``bounds`` holds boundary number ``n`` per key. Ranges read
    ``lo <= col < hi`` (``lo < col <= hi`` unless ``right``), with the first
    and last open; a discrete range reads ``col=value``. Each boundary is the
    upper end of one partition and the lower end of the next, so pairing them
    is an aggregation over two rows and needs no window.
    """
    text = boundary_text(F.col(boundary), bounds.schema[boundary].dataType)
    marked = discrete_boundaries(bounds, key, boundary)
    ends = marked.select(
        key,
        text.alias("_text"),
        F.inline(
            F.array(
                F.struct(F.col(n).cast("long").alias("part_no"), F.lit(True).alias("_upper")),
                F.struct(
                    (F.col(n) + 1).cast("long").alias("part_no"), F.lit(False).alias("_upper")
                ),
            )
        ),
        F.col("is_discrete"),
    )
    upper = F.col("_upper")
    parts = ends.groupBy(key, "part_no").agg(
        F.max(F.when(~upper, F.col("_text"))).alias("_low"),
        F.max(F.when(upper, F.col("_text"))).alias("_high"),
        F.bool_or(upper & F.col("is_discrete")).alias("_discrete"),
    )
    low, high = (" <= ", " < ") if right else (" < ", " <= ")
    ranged = F.concat(
        F.coalesce(F.concat("_low", F.lit(low)), F.lit("")),
        F.lit(col),
        F.coalesce(F.concat(F.lit(high), "_high"), F.lit("")),
    )
    single = F.concat(F.lit(f"{col}="), F.col("_low" if right else "_high"))
    return parts.select(key, "part_no", F.when(F.col("_discrete"), single).otherwise(ranged).alias("label"))


def partition_storage(
    df: DataFrame, part: str, columns: Sequence[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Per range ``(part, n_rows, bytes, avg_bytes, pct)``.

    ``bytes`` sums the widths of ``columns`` (all but ``part`` unless given)
    and ``pct`` is the share of the whole, from the aggregated rows. ``ranges``
    tells how many ranges there are, counted from 1: those without rows are
    listed too, with zero rows and bytes and no average.
    """
    measured = list(columns) if columns is not None else [c for c in df.columns if c != part]
    per_part = df.groupBy(part).agg(
        F.count("*").alias("n_rows"), F.sum(row_bytes(df, measured)).alias("bytes")
    )
    if ranges is not None:
        spark, kind = df.sparkSession, df.schema[part].dataType
        every = spark.range(1, ranges + 1).select(F.col("id").cast(kind).alias(part))
        none = F.lit(0).cast("long")
        per_part = every.join(per_part, part, "left").select(
            part, *[F.coalesce(c, none).alias(c) for c in ("n_rows", "bytes")]
        )
    # The total asks for the same aggregated columns, so both share one scan and shuffle.
    whole = per_part.agg(F.struct(F.sum("bytes").alias("b"), F.sum("n_rows")).alias("_whole"))
    return per_part.select(
        part,
        "n_rows",
        "bytes",
        F.try_divide(F.col("bytes").cast("double"), F.col("n_rows")).alias("avg_bytes"),
        F.try_divide(F.col("bytes") * F.lit(100.0), whole.scalar()["b"]).alias("pct"),
    )


def file_storage(df: DataFrame) -> DataFrame:
    """Per data file ``(file_name, n_rows, file_bytes, avg_bytes)`` of a file-based table."""
    facts = F.struct("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
    return (
        df.select(facts.alias("_file"))
        .groupBy("_file")
        .agg(F.count("*").alias("n_rows"))
        .select(
            F.col("_file.file_name").alias("file_name"),
            "n_rows",
            F.col("_file.file_size").alias("file_bytes"),
            F.try_divide(F.col("_file.file_size").cast("double"), F.col("n_rows")).alias("avg_bytes"),
        )
    )


def block_storage(df: DataFrame, part: str) -> DataFrame:
    """Where the rows of each range lie in the files of a file-based table.

    The result is ``(part, n_rows, n_files, n_blocks, stored_bytes, stored_pct)``, one row per value of
    ``part`` and one, with ``part`` NULL, for the whole. A block is what one task reads of a
    file: one row group or several. The stored bytes of a block are shared out over its rows, so a
    range has the part of each block that its rows are. The total of a table whose blocks all hold rows is the
    size of its files. ``part`` should not be NULL itself.
    """
    names = ("file_path", "file_size", "file_block_start", "file_block_length")
    block = F.struct(*[F.col(f"_metadata.{n}").alias(n) for n in names])
    counted = df.select(block.alias("_block"), part).groupBy("_block", part).agg(F.count("*").alias("_n"))
    counted = materialize(counted)  # a row per block and range: the rows are read once
    rows = counted.groupBy("_block").agg(F.sum("_n").alias("_rows"))
    shared = counted.join(rows, "_block")
    length = F.col("_block.file_block_length") * (F.col("_n") / F.col("_rows"))
    summed = shared.rollup(part).agg(
        F.grouping(part).alias("_total"),
        F.sum("_n").alias("n_rows"),
        F.count_distinct("_block.file_path").alias("n_files"),
        F.count_distinct("_block").alias("n_blocks"),
        F.sum(length).alias("stored_bytes"),
    )
    whole = counted.select("_block").distinct().agg(F.sum("_block.file_block_length")).scalar()
    return summed.select(
        part,
        "n_rows",
        "n_files",
        "n_blocks",
        "stored_bytes",
        F.try_divide(F.col("stored_bytes") * 100, whole).alias("stored_pct"),
    )


Measure = tuple[Callable[[Column], Column], Column]


def state_pivot(
    df: DataFrame,
    keys: Sequence[str | Column],
    state: str,
    states: Mapping[object, str],
    measures: Mapping[str, Measure],
) -> DataFrame:
    """One column per state for each measure, named ``<measure>_<state name>``.

    ``states`` maps values to names, and a measure is an aggregate function
    with its input. The states are given, so this is a single aggregation.
    """
    return df.groupBy(*keys).agg(
        *[
            function(F.when(F.col(state) == value, given)).alias(f"{measure}_{label}")
            for measure, (function, given) in measures.items()
            for value, label in states.items()
        ]
    )
