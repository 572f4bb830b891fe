"""What several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.plans.tables import materialize

#: Words of the near-duplicate and substring operators: split by ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a table, a NULL text as the empty one. Other columns go,
    whatever they are called."""
    return df.select(
        F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )


def lower_ascii(text: Column) -> Column:
    """Lower case for A to Z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches. Where the session names none, as in tests
    on one machine, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = f"file://{tempfile.mkdtemp(prefix='tablelens-llm-')}"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return materialize(df)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for each id in ``edges``: the smallest id it reaches.

    Alternates the large-star and small-star steps until the edges are stars. A
    step aggregates the least neighbour of each node, with partial sums on the
    map side, and joins it back, so a hub is never gathered in one value. Edges
    with a NULL end and loops link nothing.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def module_cache(name: str, make):
    """One value per Python worker, kept over tasks."""
    if name not in _CACHE:
        _CACHE[name] = make()
    return _CACHE[name]


def released(batches: Iterator, *caches: str, keep: str = "") -> Iterator:
    """The batches of a task; at its end the named caches are dropped and freed memory goes
    back to the system, as Python workers live on for other stages. What other stages have left
    in the worker goes before the task; the cache ``keep`` stays for further tasks."""
    for name in set(_CACHE) - {*caches, keep}:
        del _CACHE[name]
    try:
        yield from batches
    finally:
        for name in caches:
            _CACHE.pop(name, None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


_CACHE: dict = {}
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
