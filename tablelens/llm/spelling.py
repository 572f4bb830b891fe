"""Grouping of spelling variants by range search in k-d trees over letter counts.

A word is a vector of letter counts. Words one edit apart have counts close to each
other: a replaced letter takes one from a letter and gives one to another (L1 distance
two), an inserted letter gives one (distance one). So the near words of ``w`` are found by
two range searches, among the words of its own length and among those one letter longer;
the shorter ones find ``w`` themselves. What the search returns is verified letter by letter.

For every length a k-d tree over a bounded sample of words cuts the space of counts into
boxes; every word is put into its box, and every query is sent to the boxes within its
range. A box and the queries sent to it are one piece of work, in which a k-d tree over
the box's own words prunes further. Boxes with too many words, or queries, are dealt out over
blocks that meet two by two, so no box needs to fit a task. The sample decides only
where boxes are cut: all words are searched and the result is exact.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import parts, written
from tablelens.plans.joins import balanced_join

#: The letters, each a dimension: a to z, then U+00C0 to U+00FF.
N_LETTERS = 26 + 64
RUN, OTHER = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Characters of a text looked at at once; distinct words, and their characters, held by a task.
STEP, HELD_WORDS, HELD_CHARS = 1 << 20, 200_000, 8 << 20
#: Words by whose counts the boxes are cut.
SAMPLE_WORDS = 32_768
#: Words and queries of one piece of work, and letters of either.
BOX_WORDS, BOX_QUERIES, BLOCK_LETTERS = 32_768, 65_536, 64 << 20
#: Words of a leaf within a piece of work; cells of a distance table; letters compared, and counted, at once.
LEAF_WORDS, TABLE_CELLS, COMPARED, COUNTED = 256, 4 << 20, 16 << 20, 2 << 20


def word_counts(documents: DataFrame, min_chars: int = 6, min_count: int = 5, damage: int = 199) -> DataFrame:
    """``(word, n)``: words of whole texts and how often each occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.
    Of a run whose crc32 with its document's id is a multiple of ``damage`` one letter is
    deleted, as a stand-in for misspelt words. Words of at least ``min_chars`` letters and
    ``min_count`` occurrences over all documents are returned. NULL texts have no words; a
    NULL id is the empty text in the checksum; repeated rows count each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0

        def flushed() -> pa.RecordBatch:
            found = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(found, ["word", "n"])

        for batch in batches:
            for id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                seed = zlib.crc32(f"{id.as_py() or ''}:".encode())
                for runs in _runs(text.as_py()):
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % damage == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) >= min_chars:
                            if run not in held:
                                chars += len(run)
                            held[run] += n
                    if len(held) > HELD_WORDS or chars > HELD_CHARS:
                        yield flushed()
                        held.clear()
                        chars = 0
        if held:
            yield flushed()

    rows = documents.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text in lower case, a bounded stretch at a time; no run is cut."""
    text = text.encode().lower().decode()  # of bytes, lower case is that of A-Z alone
    at = 0
    while at < len(text):
        stop = OTHER.search(text, at + STEP)
        end = stop.start() if stop else len(text)
        yield RUN.findall(text, at, end)
        at = end


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Letter numbers of words of one length, a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)
    return np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26).astype(np.uint8)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts, a row per word."""
    n, length = letters.shape
    found = np.empty((n, N_LETTERS), np.int32)
    step = max(1, COUNTED // length)
    for a in range(0, n, step):
        some = letters[a : a + step]
        cells = some.astype(np.int64) + np.arange(len(some))[:, None] * N_LETTERS
        found[a : a + step] = np.bincount(cells.ravel(), minlength=some.shape[0] * N_LETTERS).reshape(-1, N_LETTERS)
    return found


def best_cut(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count that cut the points most evenly (at most the count, or more)."""
    low, high = points.min(axis=0), points.max(axis=0)
    best, found = 0, None
    for d in np.flatnonzero(high > low):
        tally = np.cumsum(np.bincount(points[:, d] - low[d]))[:-1]
        even = np.minimum(tally, len(points) - tally)
        if even.max() > best:
            best, found = even.max(), (int(d), int(low[d] + even.argmax()))
    return found


@dataclass
class Reach:
    """Queries still within range of a box: how many letters more (``up``) and less
    (``down``) than its own each must have to lie inside."""

    rows: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def cut(self, values: np.ndarray, bound: int, before: int | None, above: bool, most: tuple[int, int]) -> Reach:
        """The queries that reach the part at least (``above``) or at most ``bound``, where the
        box ended at ``before``; ``values`` are the queries' counts of the letter."""
        gap = bound - values if above else values - bound
        seen = 0 if before is None else np.maximum(before - values if above else values - before, 0)
        more = np.maximum(gap, 0) - seen
        up, down = (self.up + more, self.down) if above else (self.up, self.down + more)
        near = (up <= most[0]) & (down <= most[1])
        return Reach(self.rows[near], up[near], down[near])


def whole_reach(n: int) -> Reach:
    return Reach(np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32))


class Boxes:
    """The k-d tree of one length: inner nodes ``(letter, count, at most, more)``, leaves numbered."""

    def __init__(self, sample: np.ndarray, box_words: float) -> None:
        self.n = 0
        self.root = self._grow(sample, box_words)

    def _grow(self, points: np.ndarray, box_words: float):
        cut = best_cut(points) if len(points) > box_words else None
        left = points[:, cut[0]] <= cut[1] if cut else np.zeros(0, bool)
        # Words so much alike that a cut takes off a few only are dealt out over blocks.
        if not cut or 64 * min(left.sum(), (~left).sum()) < len(points):
            self.n += 1
            return self.n - 1
        return (*cut, self._grow(points[left], box_words), self._grow(points[~left], box_words))

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The box of each point."""
        found = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, int):
                found[rows] = node
            elif len(rows):
                left = points[rows, node[0]] <= node[1]
                stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return found

    def within(self, points: np.ndarray, most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the points and the boxes each can reach."""
        rows, boxes = [], []
        stack = [(self.root, whole_reach(len(points)), {}, {})]
        while stack:
            node, reach, low, high = stack.pop()
            if not len(reach.rows):
                continue
            if isinstance(node, int):
                rows.append(reach.rows)
                boxes.append(np.full(len(reach.rows), node, np.int32))
                continue
            d, t = node[:2]
            values = points[reach.rows, d]
            stack.append((node[2], reach.cut(values, t, high.get(d), False, most), low, high | {d: t}))
            stack.append((node[3], reach.cut(values, t + 1, low.get(d), True, most), low | {d: t + 1}, high))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(rows), np.concatenate(boxes)


#: For queries of the box's length and for those one letter shorter: letters gained and lost.
RANGES = {0: (1, 1), 1: (1, 0)}


def near_rows(points: np.ndarray, queries: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries and points whose counts are one edit apart, by a k-d tree over ``points``.

    Between integer counts of the same sum an L1 distance of two is a squared distance of
    two, and with one letter more a distance of one is a squared one of one, so leaves are
    compared by products.
    """
    if not len(points) or not len(queries):
        return
    # The counts of longer words would not be exact in single precision.
    exact = np.float32 if int(points.sum(axis=1).max()) < 2_000 else np.float64
    used = np.flatnonzero((points.max(axis=0) > 0) | (queries.max(axis=0) > 0))
    p, q = points[:, used].astype(exact), queries[:, used].astype(exact)
    p2, q2 = (p * p).sum(axis=1), (q * q).sum(axis=1)
    stack = [(np.arange(len(points)), whole_reach(len(queries)), {}, {})]
    while stack:
        rows, reach, low, high = stack.pop()
        if not len(reach.rows):
            continue
        cut = best_cut(points[rows]) if len(rows) > LEAF_WORDS else None
        if cut is None:
            for a in range(0, len(rows), 4_096):
                own = rows[a : a + 4_096]
                step = max(1, TABLE_CELLS // len(own))
                for b in range(0, len(reach.rows), step):
                    asked = reach.rows[b : b + step]
                    apart = q2[asked][:, None] + p2[own][None, :] - 2 * (q[asked] @ p[own].T)
                    i, j = np.nonzero(apart == (2 if kind == 0 else 1))
                    if len(i):
                        yield asked[i], own[j]
            continue
        d, t = cut
        values = queries[reach.rows, d]
        left = points[rows, d] <= t
        stack.append((rows[left], reach.cut(values, t, high.get(d), False, RANGES[kind]), low, high | {d: t}))
        stack.append((rows[~left], reach.cut(values, t + 1, low.get(d), True, RANGES[kind]), low | {d: t + 1}, high))


def one_edit(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Which rows of letters are one replaced (``kind`` 0) or one inserted letter apart."""
    if kind == 0:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


class Best:
    """Per word: near words counted, and the one of largest n (ties: first in code points)."""

    def __init__(self, size: int) -> None:
        self.n = np.zeros(size, np.int64)
        self.count = np.full(size, -1, np.int64)
        self.rank = np.zeros(size, np.int64)
        self.row = np.full(size, -1, np.int64)

    def add(self, at: np.ndarray, row: np.ndarray, count: np.ndarray, rank: np.ndarray) -> None:
        order = np.lexsort((rank, -count, at))
        at, row, count, rank = at[order], row[order], count[order], rank[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.n[at[first]] += np.diff(np.r_[first, len(at)])
        at, row, count, rank = at[first], row[first], count[first], rank[first]
        better = (count > self.count[at]) | ((count == self.count[at]) & (rank < self.rank[at]))
        at, row = at[better], row[better]
        self.count[at], self.rank[at], self.row[at] = count[better], rank[better], row


def _ranks(words: list[str]) -> np.ndarray:
    ranks = np.empty(len(words), np.int64)
    ranks[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return ranks


PIECE = ["length", "kind", "box", "i", "j"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stretches of sorted rows that belong to one piece of work, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in PIECE], axis=1)
        if last is not None and (keys[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)].tolist()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


PARTIAL = "word string, n long, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of work, one after the other: what each word of a piece found there."""
    for piece in _pieces(batches):
        asks = piece.column("asks").to_numpy(zero_copy_only=False)
        words, ns = piece.column("word").to_pylist(), piece.column("n").to_numpy()
        kind, length = piece.column("kind")[0].as_py(), piece.column("length")[0].as_py()
        own, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(own) or not len(asked):
            continue
        own_words, asked_words = [words[i] for i in own], [words[i] for i in asked]
        own_letters = letters_of(own_words, length)
        asked_letters = letters_of(asked_words, length - kind)
        own_n, asked_n = ns[own], ns[asked]
        sides = [(Best(len(asked)), asked_words, own_words, own_n, _ranks(own_words))]
        if kind == 1:  # the longer words learn of the shorter here as well
            sides.append((Best(len(own)), own_words, asked_words, asked_n, _ranks(asked_words)))
        at_once = max(1, COMPARED // length)
        for q, p in near_rows(counts_of(own_letters), counts_of(asked_letters), kind):
            for k in range(0, len(q), at_once):
                a, b = q[k : k + at_once], p[k : k + at_once]
                same = one_edit(asked_letters[a], own_letters[b], kind)
                a, b = a[same], b[same]
                if not len(a):
                    continue
                for (best, _, _, counts, ranks), x, y in zip(sides, (a, b), (b, a), strict=False):
                    best.add(x, y, counts[y], ranks[y])
        for best, names, others, _, _ in sides:
            found = np.flatnonzero(best.n)
            columns = [
                pa.array([names[i] for i in found], pa.string()),
                pa.nulls(len(found), pa.int64()),
                pa.array(best.n[found]),
                pa.array(best.count[found]),
                pa.array([others[best.row[i]] for i in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "best_n", "best"])


def _trees(words: DataFrame) -> dict[int, Boxes]:
    """The boxes of each length, cut by a bounded sample (the words first by a hash)."""
    total = words.count()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(letters_of([w], len(w)))[0] for w in batch.column("word").to_pylist()]
            lengths = pa.array([int(v.sum()) for v in found], pa.int64())
            cells = pa.array([np.minimum(v, 255).astype(np.uint8).tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([lengths, cells], ["length", "counts"])

    hashed = words.select("word", F.xxhash64("word").alias("h"))
    chosen = hashed.orderBy("h", "word").limit(SAMPLE_WORDS).select("word")
    sample: dict[int, list[np.ndarray]] = {}
    for row in chosen.mapInArrow(vectors, "length long, counts binary").collect():
        sample.setdefault(row.length, []).append(np.frombuffer(row.counts, np.uint8))
    share = min(1.0, SAMPLE_WORDS / max(total, 1))
    return {n: Boxes(np.stack(v).astype(np.int32), max(16.0, BOX_WORDS * share)) for n, v in sample.items()}


def _routes(batch: pa.RecordBatch, trees: dict[int, Boxes], lengths_in_use: set[int] | None):
    """For the words of a batch: rows, length of the tree, kind, box, and whether they ask there."""
    words = batch.column("word").to_pylist()
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    whole = Boxes(np.zeros((1, N_LETTERS), np.int32), 1)
    for length, rows in by_length.items():
        rows = np.asarray(rows)
        step = max(1, COMPARED // length)
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            counts = counts_of(letters_of([words[i] for i in some], length))
            home = trees.get(length, whole).homes(counts)
            for kind in RANGES:
                yield some, length, kind, home, False
            for kind, most in RANGES.items():
                if lengths_in_use is not None and length + kind not in lengths_in_use:
                    continue
                at, box = trees.get(length + kind, whole).within(counts, most)
                yield some[at], length + kind, kind, box, True


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, best, best_n)`` for each row of ``(word, n)``.

    ``words`` are distinct, of the letters a to z and U+00C0 to U+00FF. ``n_near`` counts the words
    that differ by exactly one inserted, deleted or replaced letter; ``best`` is the one of
    largest ``n``, of equal ones the first in code-point order, NULL if there is none.
    """
    spark = words.sparkSession
    words = written(words.select("word", "n"))
    trees = _trees(words)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for _, length, kind, boxes, asks in _routes(batch, trees, None):
                for box, n in zip(*np.unique(boxes, return_counts=True), strict=True):
                    tally[length, kind, int(box), asks] += int(n)
        if tally:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*tally, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tally.values(), pa.int64())], ["length", "kind", "box", "asks", "n"])

    counted = words.mapInArrow(sizes, "length long, kind long, box int, asks boolean, n long")
    # One row per box, kind and side: boxes are bounded by the sample, lengths by the longest word.
    total = counted.groupBy("length", "kind", "box", "asks").agg(F.sum("n").alias("n")).collect()
    blocks: dict[tuple[int, int, int, bool], int] = {}
    for r in total:
        most = max(1, min(BOX_QUERIES if r.asks else BOX_WORDS, BLOCK_LETTERS // r.length))
        blocks[r.length, r.kind, r.box, r.asks] = math.ceil(r.n / most)
    # A box without queries, or queries of a box without words, need not travel.
    met = {k[:3] for k in blocks if k[3]} & {k[:3] for k in blocks if not k[3]}
    several = {k: n for k, n in blocks.items() if n > 1 and k[:3] in met}
    lengths = {k[0] for k in met}
    fields = ["length", "kind", "box", "i", "j", "asks", "word", "n"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns = batch.column("word"), batch.column("n")
            lots = batch.column("lot").to_numpy()
            for rows, length, kind, boxes, asks in _routes(batch, trees, lengths):
                meets = np.array([(length, kind, int(b)) in met for b in boxes], bool)
                rows, boxes = rows[meets], boxes[meets]
                if not len(rows):
                    continue
                own = np.array([several.get((length, kind, int(b), asks), 1) for b in boxes], np.int64)
                other = np.array([several.get((length, kind, int(b), not asks), 1) for b in boxes], np.int64)
                copies = np.repeat(np.arange(len(rows)), other)
                dealt = (lots[rows] % own)[copies]
                repeated = np.arange(len(copies)) - np.repeat(np.cumsum(other) - other, other)
                n, at = len(copies), pa.array(rows[copies])
                i, j = (repeated, dealt) if asks else (dealt, repeated)
                columns = [
                    pa.array(np.full(n, length, np.int64)),
                    pa.array(np.full(n, kind, np.int64)),
                    pa.array(boxes[copies].astype(np.int32)),
                    pa.array(i.astype(np.int32)),
                    pa.array(j.astype(np.int32)),
                    pa.array(np.full(n, asks)),
                    names.take(at),
                    ns.take(at),
                ]
                yield pa.RecordBatch.from_arrays(columns, fields)

    schema = "length long, kind long, box int, i int, j int, asks boolean, word string, n long"
    dealt = words.withColumn("lot", F.pmod(F.xxhash64(F.lit(7), "word"), F.lit(1 << 40)))
    routed = dealt.mapInArrow(route, schema).repartition(parts(spark), *PIECE).sortWithinPartitions(*PIECE)
    found = routed.mapInArrow(_search, PARTIAL)
    none = F.lit(None)
    start = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("best_n"), none.cast("string").alias("best"))
    # Strings compare by bytes of UTF-8, which is the order of code points.
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        start.unionByName(found)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
        .select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))
    )


def variant_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point order) if that is at
    least ``ratio`` times the word's own, else NULL. ``root`` is where the forms lead in the end, the word
    itself if it has none. Each step multiplies ``n`` by ``ratio`` (above one), so there are no cycles and the number
    of rounds follows from the largest ``n``. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be above one")
    near = near_words(words)
    big = F.col("best_n") >= ratio * F.col("n")
    formed = written(
        near.select("word", "n", "n_near", F.when(big, F.col("best")).alias("form"), F.when(big, F.col("best_n")).alias("form_n"))
    )
    with_form = formed.where("form IS NOT NULL")
    pointers = with_form.select("word", F.col("form").alias("root"))
    top, least = with_form.agg(F.max("form_n"), F.min("n")).first()
    # Not more hops than this and one; a round doubles how far a pointer leads.
    hops = int(math.log(top / max(least, 1), ratio)) if top else 0
    for _ in range(hops.bit_length()):
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        step = balanced_join(pointers.select("word", "root"), onward, ["root"], "left", right_unique=True)
        pointers = written(step.select("word", F.coalesce("_on", "root").alias("root")))
    roots = pointers.select(F.col("word").alias("_word"), "root")
    joined = formed.join(roots, F.col("word") == F.col("_word"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, min_chars: int = 6, min_count: int = 5, damage: int = 199, ratio: int = 5) -> DataFrame:
    """Spelling variants among the words of whole ``documents`` texts: see ``word_counts``
    and ``variant_forms``. Columns other than ``doc_id`` and ``text`` are not looked at."""
    return variant_forms(word_counts(documents, min_chars, min_count, damage), ratio)
