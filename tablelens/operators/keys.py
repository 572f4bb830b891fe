"""Keys and references measured on the rows instead of declared."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs of a relationship label.
MAYBE, ONE, MANY, LINK = "°", "¹", "∞", "−¹"


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def all_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])


#: Relative error of the sketch, and how many such errors a set must lie below the rows to be thrown out.
SKETCH_ERROR, SKETCH_MARGIN = 0.02, 10


def _column_sets(df: DataFrame, candidates: Iterable[Sequence[str]]) -> list[tuple[str, ...]]:
    """The candidates without order or repeats, columns as in the table."""
    position = {c: i for i, c in enumerate(df.columns)}
    return list(dict.fromkeys(tuple(sorted(set(c), key=position.get)) for c in candidates))


def sketched_sets(df: DataFrame, candidates: Iterable[Sequence[str]]) -> DataFrame:
    """About how many distinct values each column set has: ``(cols, n_rows, estimate)``.

    All sets come from one scan; a sketch per set and task is all that moves.
    """
    sets = _column_sets(df, candidates)
    facts = [
        F.struct(
            F.lit(";".join(s)).alias("cols"),
            F.count("*").alias("n_rows"),
            F.approx_count_distinct(F.struct(*s), SKETCH_ERROR).alias("estimate"),
        )
        for s in sets
    ]
    return df.agg(F.array(*facts).alias("_facts")).select(F.inline("_facts"))


def unique_sets(df: DataFrame, candidates: Iterable[Sequence[str]], sketch: bool = False) -> DataFrame:
    """Which column sets are unique over the rows: ``(cols, n_rows, n_distinct, is_unique)``.

    Sets are compared without order, so a repeated candidate is tested once;
    NULLs count as equal. All sets are counted in one scan by GROUPING SETS, reduced
    to one counted row per set and value before the shuffle.

    With ``sketch`` a scan before that estimates every set and throws out those that lie ten
    standard errors below the number of rows, so only sets that may be unique are shuffled.
    Those thrown out are not unique and have ``n_distinct`` NULL. The scan runs while the query is
    planned and brings one row per set to the driver.
    """
    sets = _column_sets(df, candidates)
    out: dict[str, int] = {}
    if sketch:
        low = F.col("estimate") < F.col("n_rows") * (1 - SKETCH_MARGIN * SKETCH_ERROR)
        out = {r["cols"]: r["n_rows"] for r in sketched_sets(df, sets).where(low).collect()}
    names = {s: ";".join(s) for s in sets}
    tested = [s for s in sets if names[s] not in out]
    columns = [c for c in df.columns if any(c in s for s in tested)]
    # In the id of a grouping set a column that is not in it is a one, the first column highest.
    ids = {s: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s) for s in tested}
    none = F.lit(None).cast("long")
    listed = df.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("at"),
                        F.lit(names[s]).alias("cols"),
                        F.lit(ids.get(s)).cast("long").alias("_id"),
                        F.lit(out.get(names[s])).cast("long").alias("_rows"),
                    )
                    for i, s in enumerate(sets)
                ]
            )
        )
    )
    if not tested:
        return listed.select("cols", F.col("_rows").alias("n_rows"), none.alias("n_distinct"), F.lit(False).alias("is_unique"))
    counted = df.groupingSets([list(s) for s in tested], *columns).agg(
        F.grouping_id().cast("long").alias("_id"), F.count("*").alias("_n")
    )
    facts = counted.groupBy("_id").agg(
        F.sum("_n").alias("_sum"), F.count("*").alias("_distinct"), (F.max("_n") <= 1).alias("_unique")
    )
    is_out = F.col("_rows").isNotNull()
    zero = F.lit(0).cast("long")
    return listed.join(facts, "_id", "left").select(
        "cols",
        F.coalesce("_rows", "_sum", zero).alias("n_rows"),
        F.when(~is_out, F.coalesce("_distinct", zero)).alias("n_distinct"),
        F.when(is_out, F.lit(False)).otherwise(F.coalesce("_unique", F.lit(True))).alias("is_unique"),
    )


def fk_check(
    child: DataFrame, parent: DataFrame, cols: Mapping[str, str], name: str
) -> DataFrame:
    """Rows of a reference: ``(fk, n_null, n_orphan, n_matched, is_trusted)``.

    ``cols`` maps child columns to parent columns. A row with any NULL in the
    reference refers to nothing. The child is counted per key and the parent
    reduced to its keys before they meet, so no key is hot in the join.
    """
    refs = list(cols)
    counted = child.groupBy(*refs).agg(F.count("*").alias("_n"))
    known = parent.select(*[F.col(p).alias(c) for c, p in cols.items()]).distinct()
    joined = counted.join(known.withColumn("_known", F.lit(True)), refs, "left")
    nothing, matched = any_null(refs), F.col("_known").isNotNull()

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    return joined.agg(
        rows(nothing).alias("n_null"),
        rows(~nothing & ~matched).alias("n_orphan"),
        rows(~nothing & matched).alias("n_matched"),
    ).select(F.lit(name).alias("fk"), "*", (F.col("n_orphan") == 0).alias("is_trusted"))


@dataclass(frozen=True)
class Reference:
    """Columns of a child table that refer to a parent table."""

    child: str
    parent: str
    rows: DataFrame
    cols: Sequence[str]


def relationship_cardinality(specs: Iterable[Reference]) -> DataFrame:
    """Per child and parent: ``(child, parent, is_unique, is_nullable, label)``.

    A reference is unique when no value of its columns repeats, and nullable
    when some row has NULL in all of them. The flags of several references
    between the same pair are joined by OR.
    """

    def one_reference(s: Reference) -> DataFrame:
        counted = s.rows.groupBy(*s.cols).agg(F.count("*").alias("_n"))
        return counted.agg(
            F.coalesce(F.max("_n") == 1, F.lit(True)).alias("is_unique"),
            F.coalesce(F.bool_or(all_null(s.cols)), F.lit(False)).alias("is_nullable"),
        ).select(F.lit(s.child).alias("child"), F.lit(s.parent).alias("parent"), "*")

    pairs = (
        reduce(DataFrame.unionByName, [one_reference(s) for s in specs])
        .groupBy("child", "parent")
        .agg(F.bool_or("is_unique").alias("is_unique"), F.bool_or("is_nullable").alias("is_nullable"))
    )
    return pairs.withColumn("label", cardinality_label(F.col("is_unique"), F.col("is_nullable")))


def cardinality_label(is_unique: Column, is_nullable: Column) -> Column:
    return F.concat(
        F.when(is_nullable, MAYBE).otherwise(ONE),
        F.when(is_unique, "").otherwise(MANY),
        F.lit(LINK),
    )
