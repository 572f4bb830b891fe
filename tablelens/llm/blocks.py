"""Work on groups in bounded pieces.

A group of any size is dealt out over blocks of about ``block_rows`` rows, and
every two blocks of a group meet in one task, so a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_of_blocks(rows: DataFrame, key: str, id: str, block_rows: int) -> DataFrame:
    """``rows`` with ``_i``, ``_j`` (two blocks of the group) and ``_own`` (the block of the
    row): a row stands once for each block its own one meets, itself included."""
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    placed = rows.join(sizes, F.col(key) == F.col("_key")).drop("_key")
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(F.lit(1), id), "_blocks").cast("int"))
    met = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select(
        *rows.columns,
        F.least("_own", "_with").alias("_i"),
        F.greatest("_own", "_with").alias("_j"),
        "_own",
    )


def gathered(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Rows of the same keys side by side in one partition."""
    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of gathered rows, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, now in enumerate(zip(*columns, strict=True)):
            if now != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, now
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
