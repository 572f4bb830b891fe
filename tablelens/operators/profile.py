"""One-pass profiles of tables and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.texts import grouped_digits
from tablelens.functions.widths import fixed_width, is_sized, row_bytes, quoted
from tablelens.plans.groups import OrderedGroups
from tablelens.plans.joins import balanced_join

COLUMNS_PER_PASS = 100

# The largest number each integer type holds.
LARGEST = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}


def column_profile(df: DataFrame) -> DataFrame:
    """Per column ``(ordinal, col, type, n_rows, n_null, is_nullable, max_bytes)``.

    ``is_nullable`` is measured: whether any NULL occurs. ``max_bytes`` is the
    fixed width of the type, or the longest text or binary seen. All columns
    come from one aggregation, or one per hundred columns of a wide table.
    """
    columns = list(enumerate(df.schema.fields, start=1))

    def widest(field: T.StructField) -> Column:
        if is_sized(field.dataType):
            return F.max(F.octet_length(quoted(field.name))).cast("long")
        return F.lit(fixed_width(field.dataType)).cast("long")

    def one_pass(fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
        facts = [
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("col"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count("*").alias("n_rows"),
                F.count_if(quoted(f.name).isNull()).alias("n_null"),
                (F.count_if(quoted(f.name).isNull()) > 0).alias("is_nullable"),
                widest(f).alias("max_bytes"),
            )
            for i, f in fields
        ]
        return df.agg(F.array(*facts).alias("_facts")).select(F.inline("_facts"))

    passes = [
        one_pass(columns[at : at + COLUMNS_PER_PASS])
        for at in range(0, len(columns), COLUMNS_PER_PASS)
    ]
    return reduce(DataFrame.unionByName, passes)


def table_summary(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Per table ``(tbl, n_rows, n_parts, bytes, label)``.

    ``tables`` gives each table with the expression that names a row's
    partition, or None. The label reads ``(empty)``, ``N rows`` or ``N rows in
    K partitions``.
    """

    def one_table(name: str, df: DataFrame, part: Column | None) -> DataFrame:
        part = F.lit(0) if part is None else part
        per_part = df.groupBy(part.alias("_part")).agg(
            F.count("*").alias("_rows"), F.sum(row_bytes(df)).alias("_bytes")
        )
        return per_part.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
            F.count("_part").alias("n_parts"),
            F.sum("_bytes").alias("bytes"),
        ).select(F.lit(name).alias("tbl"), "*")

    summary = reduce(
        DataFrame.unionByName, [one_table(n, df, part) for n, (df, part) in tables.items()]
    )
    parts = F.when(
        F.col("n_parts") > 1, F.concat(F.lit(" in "), F.col("n_parts"), F.lit(" partitions"))
    )
    rows = F.concat(grouped_digits(F.col("n_rows")), F.lit(" rows"))
    label = F.when(F.col("n_rows") == 0, "(empty)").otherwise(
        F.concat(rows, F.coalesce(parts, F.lit("")))
    )
    return summary.withColumn("label", label)


def sequence_profile(df: DataFrame, col: str) -> DataFrame:
    """How an integer column runs as a sequence.

    ``(col, start_value, current_value, n_distinct, step, n_missing,
    headroom)``: ``step`` is NULL unless the values could be evenly spaced,
    ``n_missing`` counts absent values between the smallest and the largest,
    (both NULL where a bigint cannot hold them) and ``headroom`` is what the type still holds above the largest.
    """
    kind = df.schema[col].dataType
    # Of a decimal without places, as far as a bigint reaches.
    decimal = min(10**kind.precision - 1, LARGEST["bigint"]) if isinstance(kind, T.DecimalType) and not kind.scale else None
    largest = decimal or LARGEST[kind.simpleString()]
    facts = df.agg(
        F.min(col).cast("long").alias("start_value"),
        F.max(col).cast("long").alias("current_value"),
        F.count_distinct(col).alias("n_distinct"),
    )
    # Wider than a bigint: the values may lie further apart than one holds.
    span = F.col("current_value").cast("decimal(20,0)") - F.col("start_value")
    gaps = F.nullif(F.col("n_distinct") - 1, F.lit(0))
    return facts.select(
        F.lit(col).alias("col"),
        "*",
        F.when(F.try_mod(span, gaps) == 0, F.try_divide(span, gaps).try_cast("long")).alias("step"),
        (span + 1 - F.col("n_distinct")).try_cast("long").alias("n_missing"),
        (F.lit(largest).cast("long") - F.col("current_value")).alias("headroom"),
    )


def filtered_counts(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Rows under each named filter and ``n_rows`` in all, in one pass."""
    return df.agg(
        *[F.count_if(p).alias(name) for name, p in filters.items()], F.count("*").alias("n_rows")
    )


def presence_flags(
    df: DataFrame, key: str, related: Mapping[str, tuple[DataFrame, str]]
) -> DataFrame:
    """``df`` with one flag per related table: does it have a row for the key?

    The keys of all related tables are brought together and reduced to one row
    per key before they move, so a single join serves every flag.
    """
    names = list(related)
    seen = reduce(
        DataFrame.unionByName,
        [
            other.select(F.col(c).alias(key), F.lit(i).alias("_which"))
            for i, (other, c) in enumerate(related.values())
        ],
    )
    flags = seen.groupBy(key).agg(
        *[F.bool_or(F.col("_which") == i).alias(n) for i, n in enumerate(names)]
    )
    joined = balanced_join(df, flags, [key], "left", right_unique=True)
    return joined.select(
        *df.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in names]
    )


def first_match(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    order: Sequence[str],
    prefix: str | None = None,
) -> DataFrame:
    """Left rows with at most one right row, the first in a total order.

    ``on`` maps left columns to right columns; left rows without a match are
    kept. The right side keeps one row per key before it is shuffled, because
    the rank filter also runs on the map side. The columns of the right row other than
    its keys take the ``prefix``; unless it is given, only those named as a left column
    do, as ``right_``.
    """
    keys = list(on.values())
    ranked = Window.partitionBy(*keys).orderBy(*order)
    names = _right_names(left, [c for c in right.columns if c not in keys], prefix)
    first = (
        right.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") == 1)
        .select(*[F.col(r).alias(l) for l, r in on.items()], *[F.col(c).alias(n) for c, n in names.items()])
    )
    return balanced_join(left, first, list(on), "left", right_unique=True)


def _right_names(left: DataFrame, columns: Sequence[str], prefix: str | None) -> dict[str, str]:
    taken = {c.lower() for c in left.columns}
    clash = "right_" if prefix is None else prefix
    return {c: f"{clash}{c}" if prefix is not None or c.lower() in taken else c for c in columns}


def latest_match(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    at: tuple[str, str],
    order: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    strict: bool = False,
    after: bool = False,
    prefix: str | None = None,
) -> DataFrame:
    """Left rows with at most one right row: the latest one up to a point in time.

    Of the right rows with equal keys (``on`` maps left columns to right columns) and
    ``right[at[1]] <= left[at[0]]`` (``<`` if ``strict``) the one with the largest value is
    taken, of equal ones the last in ``order``, which should make the order total. With
    ``after`` it is the first right row from that point on. ``at`` may be of any type that
    has an order. Left rows without such a row, or with NULL in a key or ``at``, are kept.
    ``columns`` are those wanted of the right side, all but its keys unless given; their
    names are as in ``first_match``.

    Both sides are put in one order and the last right row is carried along it: one
    shuffle, no join, and a large key may lie in several tasks.
    """
    keys = list(on.values())
    wanted = list(columns) if columns is not None else [c for c in right.columns if c not in keys]
    names = _right_names(left, wanted, prefix)
    first = 1 if strict != after else 0  # at equal points the right row comes first, or last
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    other_key = F.struct(
        *[F.col(r).cast(left.schema[l].dataType).alias(f"k{i}") for i, (l, r) in enumerate(on.items())]
    )
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, at[1])])
    ties = F.struct(F.lit(0).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    # A right side without wanted columns still needs a struct that is not NULL.
    found = F.struct(F.lit(True).alias("met"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(wanted)])
    mine = left.select(
        key.alias("_key"),
        F.col(at[0]).alias("_at"),
        F.lit(1 - first).alias("_side"),
        F.xxhash64(*left.columns).alias("_lot"),
        F.struct("*").alias("_left"),
    )
    theirs = right.where(usable).select(
        other_key.alias("_key"),
        F.col(at[1]).cast(left.schema[at[0]].dataType).alias("_at"),
        F.lit(first).alias("_side"),
        ties.alias("_tie"),
        found.alias("_right"),
    )
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # The lot lets equal left rows lie in several ranges.
    carried = OrderedGroups(both, ["_key"], ["_at", "_side", "_tie", "_lot"]).latest("_found", F.col("_right"), not after)
    rows = carried.done().where(F.col("_left").isNotNull())
    lacks = reduce(lambda a, b: a | b, [F.col(f"_left.`{c}`").isNull() for c in (*on, at[0])])
    return rows.select(
        *[F.col(f"_left.`{c}`").alias(c) for c in left.columns],
        *[F.when(~lacks, F.col(f"_found.c{i}")).alias(names[c]) for i, c in enumerate(wanted)],
    )
