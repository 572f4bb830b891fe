"""Intermediate tables written to the shared folder of the cluster."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tablelens-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the checkpoint folder of the session.

    Only a local session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: the table stands for them."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")  # does nothing where Spark does not know it
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: no recomputing, and a lineage that
    survives lost executors. The new table knows its real size, so the
    optimizer can choose join strategies by it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """``table`` is ``df`` in ``n`` buckets by its column ``by``, in order inside them. What joins,
    groups or orders by that column needs no exchange of it.

    Rows already dealt out by ``repartition(n, by)`` make one file a bucket. The table is
    known to the session only; ``discard`` removes it once another has taken its place.
    """

    def __init__(self, df: DataFrame, n: int, by: str, order: Sequence[str] = ()) -> None:
        self.spark = df.sparkSession
        self.name = f"bucketed_by_{by.strip('_')}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{self.name}"
        writer = df.write.option("path", self.path).option("compression", "zstd")
        with shuffles_dropped(self.spark):
            writer.bucketBy(n, by).sortBy(by, *order).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
