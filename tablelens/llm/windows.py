"""Bringing equal windows of texts together.

A window is a fixed number of consecutive units (words or bytes) of one text.
The least hash of the grams in a window is its anchor; equal windows have equal
anchors. Consecutive windows with one anchor make a piece, a little longer than
a window, and pieces go to the bucket of their anchor, so all occurrences of a
window meet in one bucket whatever documents they are in. A task sends equal
pieces once, with their first place and whether there are several, so the inside
of a passage in a third of all documents is no hot group.

Across its edges the pieces differ from document to document and still have the
passage's gram as anchor. Anchors with very many different pieces are found in a
sample of the texts; their windows go one by one to the bucket of a hash of the
whole window, equal ones once per task, so that only equal windows meet. The sample
decides between the two ways only; results are the same.

A bucket answers with the windows that stay, as ranges of window starts; a
document is told nothing of the others. A task gathers the answers of its buckets and
sends one row to each partition of documents, where answers come before the texts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.common import module_cache, parts, released, written
from tablelens.llm.words import gram_hashes, mixed, sliding_least, word_hashes

#: Text that a task works on before it sends its pieces, and units in one index.
CHUNK_CHARS, INDEX_UNITS = 6_000_000, 400_000
#: Raw bytes of pieces, and single windows, that a task unpacks or sends at a time.
PORTION_BYTES, PORTION_WINDOWS = 1 << 25, 1_000_000
#: Ranges that a task gathers before it sends them, and texts that it finishes at a time.
ANSWER_RANGES, FINISH_ROWS = 1_000_000, 1_000
#: One distinct text in SAMPLE is looked at; an anchor with HOT_PIECES distinct pieces there
#: is hot. The list of hot anchors weighs 8 MB at most; it has the largest ones.
SAMPLE, HOT_PIECES, HOT_ANCHORS = 32, 100, 1_000_000
#: A NULL id sorts behind all others.
NO_ID = 2**63 - 1


class Words:
    """Windows of words, split by ASCII blanks."""

    gram = 4

    @staticmethod
    def units(data: bytes) -> tuple[list[bytes], int]:
        words = data.split()
        return words, len(words)

    @classmethod
    def grams(cls, words: list[bytes]) -> np.ndarray:
        return gram_hashes(word_hashes(words), cls.gram)

    @staticmethod
    def slices(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        text = b" ".join(words)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
        return [text[a:b] for a, b in zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)]


class Bytes:
    """Windows of bytes."""

    gram = 16

    @staticmethod
    def units(data: bytes) -> tuple[bytes, int]:
        return data, len(data)

    @classmethod
    def grams(cls, data: bytes) -> np.ndarray:
        eight = eights(data)
        return mixed(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + mixed(eight[8:]))

    @staticmethod
    def slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as one integer."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for i in range(min(8, n)):
        out[i::8] = np.frombuffer(data, "<u8", (n - i + 7) // 8, i)
    return out


@dataclass
class Pieces:
    """Pieces with their anchor, first place, number of windows, and whether they occur
    several times (``often``) or hold their anchor several times (``inner``)."""

    anchor: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    often: np.ndarray
    inner: np.ndarray
    content: list[bytes]

    def take(self, rows: np.ndarray) -> Pieces:
        arrays = (self.anchor, self.doc, self.start, self.windows, self.often, self.inner)
        return Pieces(*[a[rows] for a in arrays], [self.content[i] for i in rows.tolist()])

    def packed(self) -> bytes:
        sizes = np.fromiter(map(len, self.content), np.int64, len(self.content))
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(self.content))
        columns = b"".join(
            a.astype(k).tobytes()
            for a, k in zip(
                (self.anchor, self.doc, self.start, self.windows, self.often, self.inner, sizes),
                ("<u8", "<i8", "<i8", "<i8", "u1", "u1", "<i8"),
                strict=True,
            )
        )
        return struct.pack("<qq", len(sizes), int(sizes.sum())) + zstandard.ZstdCompressor(level=1).compress(columns) + body

    @staticmethod
    def unpacked(data: bytes, part: int = 0, of: int = 1) -> Pieces:
        """The pieces with anchors of one part."""
        (n,) = struct.unpack_from("<q", data)
        d = zstandard.ZstdDecompressor().decompressobj()
        columns, rest = d.decompress(data[16:]), d.unused_data
        body, at, arrays = zstandard.ZstdDecompressor().decompress(rest) if n else b"", 0, []
        for kind, width in (("<u8", 8), ("<i8", 8), ("<i8", 8), ("<i8", 8), ("u1", 1), ("u1", 1), ("<i8", 8)):
            arrays.append(np.frombuffer(columns, kind, n, at))
            at += n * width
        sizes = arrays.pop()
        ends = np.cumsum(sizes)
        arrays[4], arrays[5] = arrays[4].astype(bool), arrays[5].astype(bool)
        begins = ends - sizes
        if of > 1:
            rows = np.flatnonzero(mixed(arrays[0] + np.uint64(11)) % np.uint64(of) == part)
            arrays, begins, ends = [a[rows] for a in arrays], begins[rows], ends[rows]
        return Pieces(*arrays, [body[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])


@dataclass
class Singles:
    """Windows by a hash of 128 bits, with their first place and whether they occur
    several times."""

    high: np.ndarray
    low: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    often: np.ndarray

    def take(self, rows: np.ndarray) -> Singles:
        return Singles(*[a[rows] for a in (self.high, self.low, self.doc, self.start, self.often)])

    def merged(self) -> Singles:
        """Equal windows as one, with the first place."""
        order = np.lexsort((self.start, self.doc, self.low, self.high))
        high, low = self.high[order], self.low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        out = self.take(order[first])
        several = np.diff(np.append(first, len(order))) > 1
        if len(first):
            out.often = several | np.logical_or.reduceat(self.often[order], first)
        return out

    def packed(self) -> bytes:
        s = self.take(np.lexsort((self.start, self.doc)))
        doc, start = np.diff(s.doc, prepend=0), np.diff(s.start, prepend=0)
        data = b"".join(a.astype("<i8").tobytes() for a in (s.high.view(np.int64), s.low.view(np.int64), doc, start, s.often))
        shuffled = np.frombuffer(data, np.uint8).reshape(-1, 8).T.tobytes()  # equal bytes side by side
        return struct.pack("<q", len(s.doc)) + zstandard.ZstdCompressor(level=3).compress(shuffled)

    @staticmethod
    def unpacked(data: bytes, part: int = 0, of: int = 1) -> Singles:
        """The windows with hashes of one part."""
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
        high, low, doc, start, often = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<i8").reshape(5, -1)
        out = Singles(high.view(np.uint64), low.view(np.uint64), np.cumsum(doc), np.cumsum(start), often.astype(bool))
        return out.take(np.flatnonzero(out.high % np.uint64(of) == part)) if of > 1 else out

    @staticmethod
    def joined(some: list[Singles]) -> Singles:
        return Singles(*[np.concatenate([getattr(s, n) for s in some]) for n in ("high", "low", "doc", "start", "often")])


def singles_of(runs: list[tuple[int, int, np.ndarray]], span: int) -> Singles:
    """The windows of ``span`` grams in runs ``(doc, start, grams)``, equal ones as one."""
    size = np.array([len(g) for _, _, g in runs], np.int64)
    count, grams = size - span + 1, np.concatenate([g for _, _, g in runs])
    owner = np.repeat(np.arange(len(runs)), count)
    offset = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    at = (np.cumsum(size) - size)[owner] + offset
    keys = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        reach, h = 1, mixed(grams ^ np.uint64(seed))
        while reach < span:
            step = min(reach, span - reach)
            h = mixed(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            reach += step
        keys.append(h[at])
    doc, start = (np.array([r[i] for r in runs], np.int64) for i in (0, 1))
    return Singles(*keys, doc[owner], start[owner] + offset, np.zeros(len(owner), bool)).merged()


def _merged(some: list[Pieces]) -> Pieces:
    """Equal pieces as one, with the first place."""
    column = lambda name: np.concatenate([getattr(p, name) for p in some])
    content = [c for p in some for c in p.content]
    doc, start = column("doc"), column("start")
    order = np.lexsort((start, doc))
    first: dict[bytes, int] = {}
    often = column("often").copy()
    for i in order.tolist():
        j = first.setdefault(content[i], i)
        if j != i:
            often[j] = True
    rows = np.fromiter(first.values(), np.int64, len(first))
    return Pieces(column("anchor"), doc, start, column("windows"), often, column("inner"), content).take(rows)


def pieces_of(kind, doc: int, text: str, window: int) -> tuple[Pieces, np.ndarray] | None:
    """The pieces and the grams of one text; None if it has no window."""
    units, n = kind.units(text.encode("utf-8", "surrogatepass"))
    if n < window:
        return None
    grams = kind.grams(units)
    span = window - kind.gram + 1
    least = sliding_least(grams, span)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(least)]])
    # Places of the least grams; equal ones side by side inside a piece repeat its anchor.
    edge = np.zeros(span - 1, np.uint64)
    most = ~sliding_least(~np.concatenate([edge, least, edge]), span)
    places = np.flatnonzero(grams == most)
    same = np.concatenate([[0], np.cumsum(grams[places[1:]] == grams[places[:-1]])])
    low, high = np.searchsorted(places, starts), np.searchsorted(places, ends + span - 1) - 1
    inner = same[np.maximum(high, 0)] > same[np.minimum(low, len(same) - 1)]
    found = Pieces(
        least[starts],
        np.full(len(starts), doc, np.int64),
        starts.astype(np.int64),
        (ends - starts).astype(np.int64),
        np.zeros(len(starts), bool),
        inner,
        kind.slices(units, starts, ends + window - 1),
    )
    return found, grams


def _by_bucket(found: Pieces | Singles, key: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), found.take(rows).packed()


def _doc_bucket(doc: np.ndarray, homes: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64) + np.uint64(7)) % np.uint64(homes)).astype(np.int32)


def _anchors(batches: Iterator[pa.RecordBatch], kind, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            if found := pieces_of(kind, 0, text.as_py(), window):
                pieces = [int.from_bytes(blake2b(c, digest_size=8).digest(), "little", signed=True) for c in found[0].content]
                yield pa.RecordBatch.from_arrays([pa.array(found[0].anchor.view(np.int64)), pa.array(pieces, pa.int64())], ["anchor", "piece"])


def hot_anchors(rows: DataFrame, kind, window: int) -> np.ndarray:
    """The anchors with very many distinct pieces, ascending."""
    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    pairs = sample.mapInArrow(lambda b: _anchors(b, kind, window), "anchor long, piece long").distinct()
    counted = pairs.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_PIECES)
    found = counted.orderBy(F.desc("n")).limit(HOT_ANCHORS).select("anchor").toArrow()
    return np.sort(found.column("anchor").to_numpy().astype(np.int64).view(np.uint64))


def _send(
    batches: Iterator[pa.RecordBatch], kind, window: int, buckets: int, hot: np.ndarray
) -> Iterator[pa.RecordBatch]:
    held, runs, chars, windows, span = [], [], 0, 0, window - kind.gram + 1

    def rows(out: Iterator[tuple[int, bytes]], single: bool):
        out = list(out)
        for at in range(0, len(out), 64):
            b, p = zip(*out[at : at + 64], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array([single] * len(b)), pa.array(p, pa.binary())], ["bucket", "single", "packed"]
            )

    def flush():
        if held:
            found = _merged(held)
            held.clear()
            yield from rows(_by_bucket(found, found.anchor, buckets), False)

    def flush_runs():
        if runs:
            found = singles_of(runs, span)
            runs.clear()
            yield from rows(_by_bucket(found, found.low, buckets), True)

    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for i, text in zip(docs, batch.column("text"), strict=True):
            text = text.as_py()
            if both := pieces_of(kind, doc := NO_ID if i is None else i, text, window):
                found, grams = both
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, found.anchor), len(hot) - 1)] == found.anchor
                    if is_hot.any():
                        flags = np.repeat(is_hot, found.windows)
                        _, begin, size = ranges_of(flags, np.zeros(len(flags), bool), np.arange(len(flags)))
                        for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True):
                            for at in range(a, b, PORTION_WINDOWS):
                                end = min(b, at + PORTION_WINDOWS)
                                runs.append((doc, at, grams[at : end + span - 1].copy()))
                                windows += end - at + span - 1
                                if windows >= PORTION_WINDOWS:
                                    yield from flush_runs()
                                    windows = 0
                        found = found.take(np.flatnonzero(~is_hot))
                held.append(found)
                chars += len(text)
            if chars >= CHUNK_CHARS:
                yield from flush()
                chars = 0
    yield from flush()
    yield from flush_runs()


def _portions(packed: list[bytes], header: str, most: int) -> Iterator[tuple[int, int]]:
    """Numbers of parts and the number of parts so that each is about ``most``."""
    total = sum(struct.unpack_from(header, data)[-1] for data in packed)
    of = -(-total // most) or 1
    return ((part, of) for part in range(of))


def _decided(packed: list[bytes], single: bool, decide: Callable, sole: bool):
    """The ranges that stay of a bucket, a portion at a time."""
    if not single:
        for part, of in _portions(packed, "<qq", PORTION_BYTES):
            pieces = _merged([Pieces.unpacked(d, part, of) for d in packed])
            if len(pieces.doc):
                yield decide(pieces)
        return
    for part, of in _portions(packed, "<q", 4 * PORTION_WINDOWS):
        found = Singles.joined([Singles.unpacked(d, part, of) for d in packed]).merged()
        stay = ~found.often if sole else np.ones(len(found.doc), bool)
        doc, start = found.doc[stay], found.start[stay]
        yield doc, start, np.ones(len(doc), np.int64)


def _answer(
    batches: Iterator[pa.RecordBatch], decide: Callable, homes: int, sole: bool
) -> Iterator[pa.RecordBatch]:
    """Answers of one bucket after the other; the rows come sorted by bucket. What all of them
    say goes out together, so rows follow the homes and ranges, not buckets and portions."""
    held: list[bytes] = []
    told, size, last = [], 0, None

    def decided() -> Iterator[tuple]:
        nonlocal held, last
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("bucket", "single", "packed"))
            for b, single, data in zip(*columns, strict=True):
                if held and (b, single) != last:
                    yield from _decided(held, last[1], decide, sole)
                    held = []
                last = (b, single)
                held.append(data)
        if held:
            yield from _decided(held, last[1], decide, sole)

    for ranges in decided():
        told.append(ranges)
        size += len(ranges[0])
        if size >= ANSWER_RANGES:
            yield from _homes(told, homes)
            told, size = [], 0
    yield from _homes(told, homes)


def _homes(told: list[tuple], homes: int) -> Iterator[pa.RecordBatch]:
    """Ranges packed for the homes of their documents."""
    if not told:
        return
    doc, start, n = (np.concatenate(c).astype(np.int64, copy=False) for c in zip(*told, strict=True))
    home = _doc_bucket(doc, homes)
    order = np.lexsort((start, doc, home))
    doc, start, n, home = doc[order], start[order], n[order], home[order]
    out = []
    for rows in np.split(np.arange(len(home)), np.flatnonzero(np.diff(home)) + 1):
        if len(rows):
            d = np.diff(doc[rows], prepend=0)
            data = b"".join(a.astype("<i8").tobytes() for a in (d, start[rows], n[rows]))
            shuffled = np.frombuffer(data, np.uint8).reshape(-1, 8).T.tobytes()  # equal bytes side by side
            out.append((int(home[rows[0]]), zstandard.ZstdCompressor(level=3).compress(shuffled)))
    for at in range(0, len(out), 256):
        b, p = zip(*out[at : at + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["home", "packed"])


def read_ranges(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc``, ``start`` and number of windows of packed answers, by document and start."""
    found = [[], [], []]
    for data in packed:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        d, start, n = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<i8").reshape(3, -1)
        for out, a in zip(found, (np.cumsum(d), start, n), strict=True):
            out.append(a)
    doc, start, n = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
    order = np.lexsort((start, doc))
    return doc[order], start[order], n[order]


def sub_indexes(pieces: Pieces, rows: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """``rows`` in parts of about INDEX_UNITS, equal anchors in one part."""
    if not len(rows):
        return
    rows = rows[np.argsort(pieces.anchor[rows], kind="stable")]
    units = np.cumsum(pieces.windows[rows] + window - 1)
    new = np.concatenate([[True], pieces.anchor[rows][1:] != pieces.anchor[rows][:-1]])
    begin = np.flatnonzero(new)
    part = units[begin] // INDEX_UNITS
    cuts = begin[1:][np.diff(part) > 0]
    yield from np.split(rows, cuts)


def ranges_of(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray):
    """Runs of set flags as ``(owner, offset, length)``; a run ends with its owner."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    cut = np.flatnonzero((np.diff(on) > 1) | (owner[on][1:] != owner[on][:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(on)]])
    return owner[on[first]], offset[on[first]], last - first


def removed(n: int, window: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n units some window covers that no range spares."""
    covered = np.zeros(n, bool)
    windows = n - window + 1
    if windows <= 0:
        return covered
    delta = np.zeros(windows + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    gone = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
    if len(gone):
        cover = np.zeros(n + 1, np.int64)
        cover[gone] += 1
        cover[gone + window] -= 1
        covered = np.cumsum(cover[:-1]) > 0
    return covered


def dedup_windows(
    documents: DataFrame,
    kind,
    window: int,
    decide: Callable,
    finish: Callable,
    schema: str,
    sole: bool,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """The whole exchange. ``decide(pieces)`` gives the ranges that stay: the windows that
    occur once if ``sole``, else the first of equal ones. ``finish(text, start, length)``
    makes the values of a result row behind ``doc_id``. Of the row of ``documents`` the
    columns ``carry`` come along, in a struct ``carried`` as ``c0``, ``c1`` and so on."""
    if window <= kind.gram:
        raise ValueError(f"a window needs more than {kind.gram} units")
    spark = documents.sparkSession
    buckets = parts(spark)
    key, id = F.col("doc_id").cast("long"), "doc_id"
    if not documents.groupBy(F.coalesce(key, F.lit(NO_ID)).alias("id")).count().where("count > 1").isEmpty():
        # Numbers in order of id, then of the text's hash, tell rows apart.
        ordered = documents.orderBy(key.asc_nulls_last(), F.xxhash64("text"))
        documents = written(ordered.withColumn("_row", F.monotonically_increasing_id()))
        key, id = F.col("_row"), "_row"
    rows = documents.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hot = hot_anchors(rows, kind, window)
    sent = rows.mapInArrow(lambda b: released(_send(b, kind, window, buckets, hot), "word hashes"), "bucket int, single boolean, packed binary")
    gathered = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "single")
    answers = gathered.mapInArrow(lambda b: released(_answer(b, decide, buckets, sole)), "home int, packed binary")

    whole = documents.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        *([key] if id != "doc_id" else []),
        *([F.struct(*[c.alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")] if carry else []),
    )
    names = whole.columns

    def place(batches):
        for batch in batches:
            ids = batch.column(id).fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_doc_bucket(ids, buckets)), *[batch.column(n) for n in names]], ["home", *names]
            )

    placed = whole.mapInArrow(place, T.StructType([T.StructField("home", T.IntegerType()), *whole.schema]))
    fields = pa.schema([(n.split()[0], {"long": pa.int64(), "string": pa.string()}[n.split()[1]]) for n in schema.split(", ")])

    def finished(batch: pa.RecordBatch, ranges: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        doc, start, length = ranges
        out = []
        keys = batch.column(id).fill_null(NO_ID).to_pylist()
        for i, own, text in zip(batch.column("doc_id").to_pylist(), keys, batch.column("text"), strict=True):
            a, b = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
            out.append((i, *finish(text.as_py(), start[a:b], length[a:b])))
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
        kept = ["carried"] if carried else []
        return pa.RecordBatch.from_arrays([*arrays, *[batch.column(n) for n in kept]], [*fields.names, *kept])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, ranges = [], None
        for batch in batches:
            answers = batch.num_rows - batch.column("packed").null_count  # they come first
            packed += batch.column("packed").slice(0, answers).to_pylist()
            texts = batch.slice(answers)
            for at in range(0, texts.num_rows, FINISH_ROWS):
                if ranges is None:
                    ranges, packed = read_ranges(packed), []
                yield finished(texts.slice(at, FINISH_ROWS), ranges)

    kinds = {"long": T.LongType(), "string": T.StringType()}
    result = [T.StructField(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    carried = [f for f in whole.schema if f.name == "carried"]
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema]
    both = answers.select("home", *nothing, "packed").union(placed.withColumn("packed", F.lit(None).cast("binary")))
    met = both.repartitionById(buckets, "home").sortWithinPartitions(F.col("packed").isNull())
    return met.mapInArrow(lambda b: released(apply(b)), T.StructType([*result, *carried]))


__all__ = ["Bytes", "Pieces", "Words", "dedup_windows", "module_cache", "ranges_of", "removed", "sub_indexes"]
