"""Near-duplicates by HyperMinHash.

Of a document's hashed shingles, each of 128 buckets keeps the least, and of
that only the number of leading zeros and ten bits behind the first one: a
register of 16 bits. Empty buckets borrow from others in a fixed order. Four
registers make a band; documents that share a band are compared by the share of
equal registers, corrected for those that are equal by chance; what may reach
the threshold is verified on the full sets.

Not all pairs of a band are formed. First every member meets three hubs of its
group. Groups that the links so found do not put into one component are looked
at again, block by block: members of different components that may be alike, in
the first band they share, are verified there, likest first, until they are in
one component. A pair that is never verified lies in one component anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.blocks import gathered, groups, pairs_of_blocks
from tablelens.llm.common import components, parts, released, written
from tablelens.llm.words import shingle_set

SHINGLE_WORDS = 5
BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Estimates of a pair at the threshold stay above threshold - MARGIN in all but about one in
#: a million pairs (five standard deviations of 128 registers); sets of fewer
#: shingles than SMALL_SET, which buckets borrow for, are always verified.
MARGIN, SMALL_SET = 0.2, 64
#: Rows in a block of a group, without and with their texts.
BLOCK_ROWS, TEXT_BLOCK_ROWS = 4_096, 512
_EMPTY = np.uint16(0xFFFF)
#: For each bucket the order in which it looks for another one to borrow from.
_ORDER = np.argsort(np.random.default_rng(11).random((BUCKETS, BUCKETS)), axis=1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set of 64-bit hashes that is not empty."""
    buckets, first = np.unique(shingles >> np.uint64(64 - BUCKET_BITS), return_index=True)
    rest = 64 - BUCKET_BITS
    value = (shingles[first] & np.uint64((1 << rest) - 1)).astype(np.float64)
    mantissa, exponent = np.frexp(value)
    zeros = np.clip(rest - exponent, 0, 62).astype(np.uint16)
    low = np.where(value > 0, (mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    out = np.full(BUCKETS, _EMPTY, np.uint16)
    out[buckets.astype(np.int64)] = (zeros << np.uint16(MANTISSA_BITS)) | np.minimum(low, (1 << MANTISSA_BITS) - 1)
    empty = np.flatnonzero(out == _EMPTY)
    if len(empty):
        full = out != _EMPTY
        out[empty] = out[_ORDER[empty, full[_ORDER[empty]].argmax(axis=1)]]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often the registers of two disjoint sets of n and m hashes are equal. The least
    of n / BUCKETS uniform values is about exponential; the two fall into the same
    step of a register's scale with this probability, summed over the scale."""
    n, m = np.broadcast_arrays(np.maximum(n / BUCKETS, 0.5), np.maximum(m / BUCKETS, 0.5))
    high = 2.0 ** -np.arange(0, 40)
    total = np.zeros(n.shape)
    for top in high:  # one octave: values in [top / 2, top)
        inside = lambda k, t=top: np.exp(-k * t / 2) - np.exp(-k * t)
        total += inside(n) * inside(m)
    return total / (1 << MANTISSA_BITS)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the expected chance hits."""
    c = chance(n, m)
    return np.clip((equal - c) / (1 - c), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        sizes, keys, bands = [], [], []
        for text in texts:
            found = shingle_set(text, k)
            sizes.append(len(found))
            keys.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            bands.append(registers(found).view(np.int64) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )


def _matrix(column) -> np.ndarray:
    """Registers, one row each, of a column with lists of bands."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(-1, BUCKETS)


def _may_be_alike(equal: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float):
    """Which pairs may reach the threshold, by their equal registers and sizes."""
    least = np.minimum(n, m)
    sizes = least >= threshold * np.maximum(n, m)
    # An estimate is never above the share of equal registers.
    out = sizes & ((equal >= threshold - MARGIN) | (least < SMALL_SET))
    close = np.nonzero(out & (least >= SMALL_SET))
    n, m = np.broadcast_arrays(n, m)
    out[close] = estimate(equal[close], n[close], m[close]) >= threshold - MARGIN
    return out


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose estimate leaves a link possible."""
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}"))

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(f"n_{c}").to_numpy(zero_copy_only=False) for c in "ab")
                equal = (_matrix(batch.column("bands_a")) == _matrix(batch.column("bands_b"))).mean(axis=-1)
                fit = _may_be_alike(equal, n, m, threshold)
                yield batch.select(["a", "b"]).filter(pa.array(fit))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def _candidates(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of one group that lie in different components, may be
    alike, and share no earlier band; those with most equal registers first."""
    matrix, n = _matrix(group.column("bands")), group.column("n").to_numpy()
    of, own, band = (group.column(c).to_numpy() for c in ("component", "_own", "band"))
    first, last = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
    found, places = [], np.arange(len(n))
    none = np.empty(0, np.int32)
    for start in range(0, len(n), 64):
        some = places[start : start + 64, None]
        later = places > some if first == last else (own[some] == first) & (own != first)
        later &= of[some] != of
        if not later.any():
            continue
        equal = (matrix[some] == matrix).mean(axis=-1)
        i, j = np.nonzero(later & _may_be_alike(equal, n[some], n, threshold))
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            shared = (matrix[a + start] == matrix[b]).reshape(len(a), -1, BAND).all(axis=-1).argmax(axis=-1)
            here = shared == band[b]
            a, b = a[here], b[here]
            found.append((equal[a, b].astype(np.float32), (a + start).astype(np.int32), b.astype(np.int32)))
    if not found:
        return none, none
    equal, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((j, i, -equal))
    return i[order], j[order]


def _in_steps(i: np.ndarray, j: np.ndarray, step: int = 100_000) -> Iterator[tuple[int, int]]:
    for at in range(0, len(i), step):
        yield from zip(i[at : at + step].tolist(), j[at : at + step].tolist(), strict=True)


def _live(torn: DataFrame, threshold: float) -> DataFrame:
    """``(key, rep)`` of the members that have a candidate."""

    def mark(batches):
        for group in groups(batches, ["key", "_i", "_j"]):
            i, j = _candidates(group, threshold)
            if len(i):
                rows = np.unique(np.concatenate([np.unique(i), np.unique(j)]))
                yield from group.select(["key", "rep"]).take(rows).combine_chunks().to_batches()

    met = gathered(pairs_of_blocks(torn, "key", "rep", BLOCK_ROWS), ["key", "_i", "_j"], parts(torn.sparkSession))
    return met.mapInArrow(lambda b: released(mark(b)), "key long, rep long").distinct()


def _joined(live: DataFrame, threshold: float, k: int, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` that join the components of live members."""

    def join(batches):
        for group in groups(batches, ["key", "_i", "_j"]):
            ids, of = group.column("rep").to_numpy(), group.column("component").to_numpy().tolist()
            texts, sets, links = group.column("text"), {}, []
            root = {c: c for c in of}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, j in _in_steps(*_candidates(group, threshold)):
                a, b = top(of[i]), top(of[j])
                if a == b:
                    continue
                for x in (i, j):
                    if x not in sets:
                        sets[x] = shingle_set(texts[x].as_py(), k)
                if _alike(sets[i], sets[j], percent):
                    root[a] = b
                    links.append((ids[i], ids[j]))
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    met = gathered(pairs_of_blocks(live, "key", "rep", TEXT_BLOCK_ROWS), ["key", "_i", "_j"], parts(live.sparkSession))
    return met.mapInArrow(lambda b: released(join(b)), "a long, b long").distinct()


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def check(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            for a, b, text_a, text_b in zip(*columns, strict=True):
                if len(known) > 200:
                    known.clear()
                for i, text in ((a, text_a), (b, text_b)):
                    if i not in known:
                        known[i] = shingle_set(text, k)
                out.append(_alike(known[a], known[b], percent))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(rep, text)`` of the given ids."""
    wanted = written(ids.distinct())
    return written(rows.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "text").dropDuplicates(["rep"]))


def near_duplicates(documents: DataFrame, percent: int = 75, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``documents``.

    Documents whose sets of shingles have a Jaccard similarity of at least ``percent``
    are linked; ``component_id`` is the smallest id reachable. Equal sets are one
    class from the start. Texts without words, NULL and empty ones included, have no
    shingles and link with nothing. A row with a NULL id stands alone: its component
    is NULL and it is kept. Ids should be unique: rows that share one are each
    placed by their own text. An empty table gives no rows; other columns are not
    read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"
    every = written(rows.mapInArrow(lambda b: released(_sketch(b, shingle_words), "word hashes"), schema))
    classes = written(
        every.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    )
    sketches = written(
        every.join(classes, (every.set_key == classes.set_key) & (F.col("doc_id") == F.col("rep")))
        .select("rep", F.col("n_shingles").alias("n"), "bands")
        .dropDuplicates(["rep"])
    )
    banded = sketches.select("rep", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("key"), "rep", "band"
    )
    # Three hubs of a group: its smallest and largest member and one by hash.
    hubs = banded.groupBy("key").agg(
        F.min("rep").alias("low"), F.max("rep").alias("high"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).getField("rep").alias("any")
    )
    members = written(banded.join(hubs.where("low < high"), "key"))
    met = members.select("rep", F.explode(F.array_distinct(F.array("low", "high", "any"))).alias("hub"))
    tried = written(
        _estimated(
            met.where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(),
            sketches,
            percent / 100,
        )
    )
    threshold = percent / 100
    links = written(_verified(tried, _texts_of(rows, tried.select(F.explode(F.array("a", "b")).alias("rep"))), shingle_words, percent))
    reached = written(components(links))
    # Groups whose members are not all in one component yet.
    placed = members.select("key", "band", "rep").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    placed = written(placed.withColumn("component", F.coalesce("component", "rep")))
    torn = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    torn = written(placed.join(torn.select("key"), "key").join(sketches, "rep"))
    live = written(_live(torn, threshold))
    if not live.isEmpty():
        live = torn.join(live, ["key", "rep"]).join(_texts_of(rows, live.select("rep")), "rep")
        more = written(_joined(live, threshold, shingle_words, percent))
        reached = written(components(links.unionByName(more)))
    placed = every.join(classes, "set_key", "left")
    placed = placed.join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
