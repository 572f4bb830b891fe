"""From raw documents to packed training sequences, in four stages.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import table, written
from tablelens.llm.fmindex import without_substrings
from tablelens.llm.minhash import near_duplicates
from tablelens.llm.packing import pack_documents
from tablelens.llm.quality import score_quality
from tablelens.llm.queries import JSON, KEEP_SCORE, quality_model, ship


#: Pieces of texts in each of two generations that a worker remembers the ids of.
CACHED_PIECES = 100_000


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns by their whole names, dots and all."""
    return [F.col(f"`{c}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labels of ``sf_dir``.

    A NULL text is scored as the empty one. Every row is judged by itself, NULL and repeated ids alike, and
    keeps all its columns as they are, whatever their names.
    """
    ship(spark)
    whole = docs.select(F.struct(*columns_of(docs)).alias("doc"), F.col("text"))
    scored = score_quality(whole, quality_model(spark, sf_dir), threshold=KEEP_SCORE)
    return scored.where("predicted = 1").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows are dropped, not ids: where an id is NULL or repeated, rows are numbered in order of
    id (NULL last) and of a hash of the text, and the first of a group stays. Texts without
    words link with nothing and stay. The numbered table is written once.
    """
    ship(spark)
    columns, id = columns_of(docs), "doc_id"
    odd = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if not odd.isEmpty():
        id = "numbered_row_of_documents"
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        docs = written(ordered.withColumn(id, F.monotonically_increasing_id()))
    found = near_duplicates(docs.select(F.col(id).alias("doc_id"), "text"))
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("dropped_row_of_documents"))
    return docs.join(dropped, F.col(id) == F.col("dropped_row_of_documents"), "left_anti").select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go. A text that loses nothing stays as it is; one that
    loses words is what is left, joined by blanks; one that loses all goes. NULL is the last
    id, and rows of one id are told apart in order of a hash of the text."""
    ship(spark)
    found = without_substrings(docs).where("n_removed = 0 OR text != ''")
    changed = {"n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))}
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids. A NULL text is empty: its end id alone.
    Executors come here with their heaps grown by the stages before, so workers remember less."""
    ship(spark)
    return pack_documents(docs, JSON, end_id=1, cached_pieces=CACHED_PIECES)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Rules fitted on labels, sketches and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
