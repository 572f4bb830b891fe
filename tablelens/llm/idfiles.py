"""Token ids in binary files: one zstandard dictionary, one frame per document.

A shard file is, in this order: ``MAGIC``; the sha256 of the dictionary (32
bytes); one zstandard frame per document, of its ids as little-endian unsigned
integers of ``width`` bytes; the index; the footer. The index has, for n
documents, n document ids, n + 1 frame offsets and n id counts, each as
little-endian 64-bit integers. The footer is the place of the index, n, the
width and ``MAGIC``, 8 bytes each. A NULL document id is written as the
smallest 64-bit integer. One document is read with the footer, the index and
one frame, without touching its neighbours.

The dictionary, trained on ids of a bounded sample, is a file of its own,
named by its hash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import parts, written
from tablelens.llm.encoding import encoded_in_steps, text_encoder

MAGIC = b"TLIDZST1"
NO_ID = -(2**63)
FOOTER_BYTES = 32
#: Bounds of the sample that the dictionary is trained on.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 1_000, 8_192, 65_536


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes documents one by one; the file appears under its name on ``close``."""

    def __init__(self, uri: str, dictionary: bytes, width: int, level: int = 1) -> None:
        self.store, self.path = _place(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.own)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=given)
        self.width, self.ids, self.offsets, self.counts = width, [], [], []
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at = len(MAGIC) + 32

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        frame = self.compressor.compress(tokens.astype(f"<u{self.width}").tobytes())
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.offsets.append(self.at)
        self.counts.append(len(tokens))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        columns = (self.ids, [*self.offsets, self.at], self.counts)
        self.out.write(b"".join(np.asarray(c, "<i8").tobytes() for c in columns))
        self.out.write(np.asarray([self.at, len(self.ids), self.width], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.store.move(self.own, self.path)


class ShardReader:
    def __init__(self, uri: str, dictionary: bytes) -> None:
        store, path = _place(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC or tail[24:] != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index, self.n, self.width = np.frombuffer(tail[:24], "<i8").tolist()
        found = np.frombuffer(self.file.read_at(size - FOOTER_BYTES - index, index), "<i8")
        self.ids, self.offsets, self.counts = found[: self.n], found[self.n : 2 * self.n + 1], found[2 * self.n + 1 :]
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=given)

    def tokens(self, row: int) -> np.ndarray:
        """The ids of one document, by its row in the file."""
        start, end, count = int(self.offsets[row]), int(self.offsets[row + 1]), int(self.counts[row])
        frame = self.file.read_at(end - start, start)
        data = self.decompressor.decompress(frame, max_output_size=count * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the document with this id, or None."""
        row = int(np.searchsorted(self.ids, doc_id))
        return self.tokens(row) if row < self.n and self.ids[row] == doc_id else None


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where the samples are too few."""
    if sum(map(len, samples)) < 16 * 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # all samples alike, say: no dictionary then
        return b""


def _sample(documents: DataFrame, tokenizer: str, width: int) -> list[bytes]:
    def encode(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [i[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for _, i in encoded_in_steps(text_encoder(tokenizer), texts)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.binary())], ["h", "ids"])

    hashed = documents.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen = hashed.orderBy("h").limit(SAMPLE_DOCUMENTS)
    rows = chosen.mapInArrow(encode, "h long, ids binary").collect()
    return [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.h, bytes(r.ids))) if r.ids]


def write_id_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, level: int = 1) -> DataFrame:
    """Write ``(doc_id, text)`` to shard files below ``folder``; one row per file.

    Documents are in ascending order of id over the files, NULL ids first, rows of
    one id by a hash of their text; each is the ids of its whole text (NULL:
    empty) and ``end_id``. The result is ``(shard, path, dictionary, width, n_docs,
    n_tokens, start)``: ``start`` counts the ids in earlier files. It is written, so
    the files are made once. A file is complete or absent: a repeated task writes
    another file, and only the listed ones count. An empty table gives no file.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 65_536 else 4
    dictionary = train_dictionary(_sample(rows, tokenizer, width))
    name = f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dictionary"
    store, path = _place(name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(dictionary)
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts(spark), "doc_id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, total = TaskContext.get().partitionId(), None, 0
        uri = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.idz"
        encoder = text_encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = out or ShardWriter(uri, dictionary, width, level)
            for i, found in encoded_in_steps(encoder, texts):
                out.add(ids[i], np.append(found, np.uint32(end_id)))
                total += len(found) + 1
        if out:
            out.close()
            row = {"shard": [shard], "path": [uri], "dictionary": [name], "width": [width], "n_docs": [len(out.ids)], "n_tokens": [total]}
            yield pa.RecordBatch.from_pydict(row)

    files = written(
        ordered.sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
        .mapInArrow(write, "shard long, path string, dictionary string, width long, n_docs long, n_tokens long")
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_id_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of all documents in the listed
    files; ``start`` counts the ids of all documents before, ``ids`` are little-endian
    unsigned 32-bit integers, NULL without ``with_ids``."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _place(row["dictionary"])
                with store.open_input_stream(path) as source:
                    dictionary = source.read()
                reader, at = ShardReader(row["path"], dictionary), row["start"]
                for first in range(0, reader.n, 1_000):
                    rows = []
                    for i in range(first, min(reader.n, first + 1_000)):
                        tokens = reader.tokens(i)
                        doc = int(reader.ids[i])
                        data = tokens.tobytes()
                        rows.append((None if doc == NO_ID else doc, at, len(tokens), zlib.crc32(data), data if with_ids else None))
                        at += len(tokens)
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return (
        files.select("path", "dictionary", "start")
        .repartition(parts(spark), "path")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    )
