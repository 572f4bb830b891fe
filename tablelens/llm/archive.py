"""A content-addressed archive of web pages, and WARC files made from it.

The archive is two written tables. ``payloads`` holds every distinct payload of at least
``least`` bytes once, by its sha256. ``headers`` holds one row per record: the exact bytes that
stand before the payload in its WARC record, and the payload itself only where it is shorter
than that. The records are brought back by joining the two on the digest.

Payloads move once, reduced to one per digest and task before they do; what decides
between response and revisit are narrow rows of ids and digests.

WARC files have one gzip member per record, so a reader may start at any of them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import parts
from tablelens.plans.joins import balanced_join

#: Payloads below this size are kept with their headers and never shared.
LEAST_BYTES = 100
#: Copies of one row that are numbered together; bytes of a file after which the next begins.
COPIES, FILE_BYTES = 10_000, 1 << 30
#: Bytes read, and payload bytes returned, at once.
READ_BYTES, HELD_BYTES = 1 << 20, 32 << 20
#: Fixed values of the format.
END, REVISIT_PROFILE = b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """The places of the two tables. Payloads are dealt out over buckets by digest; a session
    that knows them by ``table`` joins them without moving them, others read the files."""

    headers: str
    payloads: str
    table: str

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        known = spark.catalog.tableExists(self.table)
        return spark.read.parquet(self.headers), spark.table(self.table) if known else spark.read.parquet(self.payloads)


def _uuid(*of: str) -> Column:
    """A record id that follows from the values: a repeated task gives the same."""
    h = F.sha2(F.to_json(F.struct(*of), {"ignoreNullFields": "false"}), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4])


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is NULL. Line breaks within are escaped."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit("\r\n")), F.lit(""))


def archive_pages(
    pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> Archive:
    """Store ``(page_id, url, html)`` below ``folder``; other columns are not looked at.

    Of the records with equal payloads of at least ``least`` bytes, the one with the
    smallest page id (then url; NULL ids last) is a response, the others revisit it; smaller
    ones are all responses. Repeated rows are records of their own: the first is the response.
    A NULL html is an empty payload, a NULL url gives no target line. Equal digests of
    different payloads end the job. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    small = F.when(F.col("size") < least, F.col("payload"))
    facts = rows.select("page_id", "url", "digest", "size", small.alias("inline"))
    same = facts.groupBy(*facts.columns).agg(F.count("*").alias("copies"))
    # Copies of one row are numbered, ten thousand to a row and then one by one elsewhere.
    blocks = same.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    dealt = blocks.repartition(parts(spark), "page_id", "url", "digest", "block")
    first_copy = F.col("block") * COPIES
    last_copy = F.least(first_copy + COPIES, F.col("copies")) - 1
    records = dealt.withColumn("copy", F.explode(F.sequence(first_copy, last_copy))).drop("block")
    records = records.withColumn("record", _uuid("page_id", "url", "digest", "copy"))

    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    shared = (
        same.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.sum("copies").alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), F.lit(0).cast("long").alias("copy"))
    )
    targets = shared.select("digest", _uuid("page_id", "url", "digest", "copy").alias("target"), F.col("page_id").alias("refers_to"))
    joined = balanced_join(records, targets, ["digest"], "left", right_unique=True)
    is_revisit = F.coalesce(F.col("target") != F.col("record"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Profile", F.when(is_revisit, REVISIT_PROFILE)),
        _line("WARC-Refers-To", F.when(is_revisit, F.concat(F.lit("<urn:uuid:"), "target", F.lit(">")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length),
        F.lit("\r\n"),
        http,
    )
    headers = joined.select(
        "record", "page_id", "digest", "size", is_revisit.alias("is_revisit"), head.cast("binary").alias("head"), "inline"
    )

    check = F.struct("size", F.xxhash64("payload").alias("h"))
    differs = F.col("most") != F.col("least")
    payloads = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.any_value("payload").alias("payload"), F.min(check).alias("least"), F.max(check).alias("most"))
        .select("digest", F.when(differs, F.raise_error(F.lit("two payloads of one digest"))).otherwise(F.col("payload")).alias("payload"))
    )
    name = f"archive_{uuid.uuid4().hex}"
    place = f"{folder.rstrip('/')}/{name}"
    found = Archive(f"{place}/headers", f"{place}/payloads", name)
    headers.write.option("compression", "zstd").parquet(found.headers)
    # Grouped by digest they lie as the buckets want them: nothing moves again.
    buckets = payloads.write.option("compression", "zstd").option("path", found.payloads).bucketBy(parts(spark), "digest")
    buckets.saveAsTable(name)
    return found


def original_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``(record, bytes)``: the whole WARC records, rebuilt from headers and payloads.

    Revisits and short payloads need no join, so the digests in it are unique."""
    headers, payloads = archive.read(spark)
    joins = ~F.col("is_revisit") & F.col("inline").isNull()
    alone = headers.where(~joins).select("record", F.concat("head", F.coalesce("inline", F.lit(b"")), F.lit(END)).alias("bytes"))
    whole = headers.where(joins).join(payloads, "digest", "left")
    found = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), "digest")).cast("binary"))
    return whole.select("record", F.concat("head", found, F.lit(END)).alias("bytes")).unionByName(alone)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class WarcWriter:
    """Writes records one by one; the file appears under its name on ``close``."""

    def __init__(self, uri: str, level: int) -> None:
        self.uri, self.level, self.n, self.size = uri, level, 0, 0
        self.store, self.path = _place(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(f"{self.path}.part", compression=None)

    def add(self, record: bytes) -> None:
        member = zlib.compressobj(self.level, wbits=31)
        data = member.compress(record) + member.flush()
        self.out.write(data)
        self.n, self.size = self.n + 1, self.size + len(data)

    def close(self) -> dict:
        self.out.close()
        self.store.move(f"{self.path}.part", self.path)
        return {"path": [self.uri], "n_records": [self.n], "n_bytes": [self.size]}


def write_warc_files(records: DataFrame, folder: str, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the column ``bytes`` of ``records`` to ``*.warc.gz`` below ``folder``; one row
    ``(path, n_records, n_bytes)`` per file. A file is complete or absent: a repeated task
    writes others, and only those in the result count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for record in batch.column(0):
                out = out or WarcWriter(f"{folder.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.gz", level)
                out.add(record.as_buffer().to_pybytes())
                if out.size >= file_bytes:
                    yield pa.RecordBatch.from_pydict(out.close())
                    out = None
        if out:
            yield pa.RecordBatch.from_pydict(out.close())

    files = records.select("bytes").mapInArrow(write, "path string, n_records long, n_bytes long")
    place = f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"
    files.write.parquet(place)
    return records.sparkSession.read.schema(files.schema).parquet(place)


def members(uri: str) -> Iterator[bytes]:
    """The records of a file, one gzip member each."""
    store, path = _place(uri)
    with store.open_input_stream(path, compression=None) as source:
        rest = b""
        while True:
            member, held = zlib.decompressobj(wbits=31), []
            data = rest or source.read(READ_BYTES)
            if not data:
                return
            while not member.eof:
                if not data:
                    raise ValueError(f"{uri} ends within a record")
                held.append(member.decompress(data))
                data = source.read(READ_BYTES) if not member.eof else b""
            rest = member.unused_data
            yield b"".join(held)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of a record, names in lower case, and its block."""
    head, _, rest = record.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != END:
        raise ValueError("this is no WARC record")
    return fields, rest[:size]


FOUND = "page_id {kind}, url string, record string, refers string, digest string, size long, payload binary"


def read_warc_files(files: DataFrame, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """``(page_id, url, record, refers, digest, size, payload)`` of every record in the
    files of column ``path``. The payload of a response is verified against its digest;
    a revisit has ``refers``, the record it refers to, and neither ``size`` nor ``payload``.
    ``with_payload=False`` leaves payloads out after verifying them. ``page_id`` has the type
    ``id_type``, long or string."""
    number = pa.int64() if id_type in ("long", "bigint") else pa.string()
    kinds = [number, *[pa.string()] * 4, pa.int64(), pa.binary()]
    names = ["page_id", "url", "record", "refers", "digest", "size", "payload"]

    def row(record: bytes) -> tuple:
        fields, block = parse_record(record)
        id = fields.get("x-page-id")
        known = fields["warc-payload-digest"].removeprefix("sha256:")
        bare = [v and v.removeprefix("<urn:uuid:").removesuffix(">") for v in (fields["warc-record-id"], fields.get("warc-refers-to"))]
        start = (id if id is None or number == pa.string() else int(id), fields.get("warc-target-uri"), *bare, known)
        if fields["warc-type"] == "revisit":
            return (*start, None, None)
        payload = block.partition(END)[2]
        if hashlib.sha256(payload).hexdigest() != known:
            raise ValueError(f"the payload of record {bare[0]} has another digest")
        return (*start, len(payload), payload if with_payload else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for record in members(path):
                    rows.append(row(record))
                    held += len(record) if with_payload else 500
                    if held > HELD_BYTES:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    spread = files.select("path").repartition(parts(files.sparkSession), "path")
    return spread.mapInArrow(read, FOUND.format(kind=id_type))


def page_captures(records: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` from the
    result of ``read_warc_files``: revisits take size and digest from the response they refer to,
    whose digest must be their own; ``refers_to`` is its page id, NULL for a response."""
    responses = records.where("refers IS NULL").select(
        F.col("record").alias("refers"), F.col("page_id").alias("_page"), F.col("size").alias("_size"), F.col("digest").alias("_digest")
    )
    revisits = balanced_join(
        records.where("refers IS NOT NULL").drop("payload"), responses, ["refers"], "left", right_unique=True
    )
    agreed = F.when(F.col("_digest") == F.col("digest"), F.col("digest"))
    lost = F.raise_error(F.concat(F.lit("record "), "record", F.lit(" refers to no such payload"))).cast("string")
    first = records.where("refers IS NULL").select(
        "page_id",
        "url",
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast(records.schema["page_id"].dataType).alias("refers_to"),
    )
    again = revisits.select(
        "page_id",
        "url",
        F.col("_size").alias("payload_bytes"),
        F.coalesce(agreed, lost).alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        F.col("_page").alias("refers_to"),
    )
    return first.unionByName(again)
