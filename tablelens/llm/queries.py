"""The operators of this package over whole given tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.archive import archive_pages, original_records, page_captures, read_warc_files, write_warc_files
from tablelens.llm.bpe import encode_texts
from tablelens.llm.bwt import dedup_bytes
from tablelens.llm.common import shared_folder, table, written
from tablelens.llm.fmindex import dedup_substrings
from tablelens.llm.forest import near_vectors
from tablelens.llm.idfiles import read_id_files, write_id_files
from tablelens.llm.minhash import near_duplicates
from tablelens.llm.packing import pack_documents
from tablelens.llm.perspectives import rotate_perspectives
from tablelens.llm.quality import score_quality, train
from tablelens.llm.spelling import spelling_variants
from tablelens.llm.whiten import whiten
from tablelens.llm.winnowing import compare_edited

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: From this score on a document is taken for good.
KEEP_SCORE = 0.3

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    name = f"{tempfile.mkdtemp(prefix='tablelens-code-')}/tablelens.zip"  # Spark sends it on
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, folder: str):
    labels = table(spark, folder, "labels").where(~held_out())
    return train(table(spark, folder, "documents"), labels)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    model = quality_model(spark, folder)
    scored = score_quality(table(spark, folder, "documents").select("doc_id", "text"), model, threshold=KEEP_SCORE)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op3_fm_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edited(table(spark, folder, "documents"))


def op6_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"), JSON, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_id_files(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    files = write_id_files(table(spark, folder, "documents"), place, JSON, end_id=2)
    return read_id_files(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return rotate_perspectives(table(spark, folder, "conversations"))


def op9_bwt_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_bytes(table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_monoid_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_texts(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN, with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_content_archive(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive = archive_pages(table(spark, folder, "pages"), place)
    files = write_warc_files(original_records(spark, archive), place)
    # What is read is needed twice, by the responses and by what refers to them.
    records = written(read_warc_files(files, with_payload=False))
    return page_captures(records).drop("url")


def op12_letter_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _with_package(q)
    for q in (
        op1_quality_rules,
        op2_projection_forest,
        op3_fm_index_dedup,
        op4_hyperminhash,
        op5_winnowing,
        op6_vector_packing,
        op7_id_files,
        op8_perspectives,
        op9_bwt_dedup,
        op10_monoid_bpe,
        op11_content_archive,
        op12_letter_counts,
        op13_whitening,
    )
}
