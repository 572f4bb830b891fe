"""Substring dedup by a compressed FM-index of each shard.

Shards are the buckets of ``windows``. A shard's distinct pieces are one text
over word numbers; its Burrows-Wheeler transform is kept as a wavelet matrix of
bit vectors with block counts. Pieces are streamed against the index from
right to left: a backward step adds a word to all current matches at once, a
match longer than the threshold is cut back to it, and what remains is the
interval of all occurrences of the window that starts here.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.windows import Pieces, Words, dedup_windows, ranges_of, removed, sub_indexes

WINDOW_WORDS = 20


class BitVector:
    """Bits in words of 64 with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:], dtype=np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(inside)


class WaveletMatrix:
    """Rank queries on a sequence of symbols below ``symbols``."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.vectors, self.zeros = [], []
        now = values
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level) & 1
            self.vectors.append(BitVector(bits))
            self.zeros.append(int(len(now) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.empty(0, np.int64)
        self.begin = np.zeros(symbols, np.int64)
        self.begin[now[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place. Symbols must occur."""
        for i, vector in enumerate(self.vectors):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            ones = vector.ones(at)
            at = np.where(bit == 1, ones + self.zeros[i], at - ones)
        return at - self.begin[symbol]


class FmIndex:
    """The index of pieces of numbered words; every piece is closed by a 0.

    Suffixes are sorted by as many symbols as a match can have, ``depth`` + 1 at
    least; an interval of a shorter match depends on no more.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        levels = {1: rank}
        while True:
            later = np.zeros(n, np.int64)
            later[: max(n - reach, 0)] = rank[reach:] + 1
            pair = rank * (n + symbols + 2) + later
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            reach *= 2
            levels[reach] = rank
            if reach > depth:
                break
        self.order, self.depth = order, depth
        self.bwt = text[order - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelets = WaveletMatrix(self.bwt, symbols)
        # Suffixes that agree in ``depth`` symbols, from two ranks that overlap.
        half = 1 << (depth.bit_length() - 1)
        if half == depth:
            agree = levels[half]
        else:
            later = np.full(n, -1, np.int64)
            step = depth - half
            later[: n - step] = levels[half][step:]
            agree = levels[half] * (n + 1) + later
        key = agree[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.empty(0, bool)
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.bounds = np.concatenate([self.first, [n]])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Put a symbol before each match."""
        base = self.counts[symbol]
        return base + self.wavelets.rank(symbol, low), base + self.wavelets.rank(symbol, high)

    def matches(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each place of the streamed pieces ``text[begin : begin + size]`` the interval
        of the match of ``depth`` symbols that starts there, as its group, or -1 where the
        matching statistic is below ``depth``. Streamed pieces are pieces of the index,
        as equal windows share a shard, so no step fails."""
        out = np.full(len(text), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.order), np.int64)
        length = np.zeros(len(begin), np.int64)
        left = -np.sort(-size)
        for step in range(1, int(size[0]) + 1 if len(size) else 0):
            k = int(np.searchsorted(-left, -step, side="right"))  # pieces with that many symbols
            at = begin[:k] + size[:k] - step
            a, b = self.extend(text[at], low[:k], high[:k])
            length[:k] += 1
            full = length[:k] >= self.depth
            group = self.group[a]
            a = np.where(full, self.bounds[group], a)
            b = np.where(full, self.bounds[group + 1], b)
            length[:k] = np.minimum(length[:k], self.depth)
            out[at[full]] = group[full]
            low[:k], high[:k] = a, b
        return out


def _numbered(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Words of pieces as numbers from 1 on, a 0 behind each piece; where pieces begin,
    their sizes, and how many symbols there are."""
    numbers: dict[bytes, int] = {}
    new = numbers.setdefault
    flat: list[int] = []
    sizes = []
    for content in contents:
        words = content.split()
        flat += [new(w, len(numbers) + 1) for w in words]
        flat.append(0)
        sizes.append(len(words))
    size = np.array(sizes, np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    return np.array(flat, np.int64), begin, size, len(numbers) + 1


def first_windows(pieces: Pieces, window: int):
    """The first occurrences of all windows, as ranges ``(doc, start, n)``. Pieces whose
    anchor occurs once, and that hold it once, repeat nothing and are not indexed."""
    _, group, total = np.unique(pieces.anchor, return_inverse=True, return_counts=True)
    again = (total[group] > 1) | pieces.often | pieces.inner
    again = np.bincount(group, again, len(total))[group] > 0
    alone = np.flatnonzero(~again)
    out = [(pieces.doc[alone], pieces.start[alone], pieces.windows[alone])]
    for rows in sub_indexes(pieces, np.flatnonzero(again), window):
        some = pieces.take(rows)
        text, begin, size, symbols = _numbered(some.content)
        index = FmIndex(text, symbols, window)
        found = index.matches(text, begin, size)
        owner = np.repeat(np.arange(len(size)), size + 1)
        offset = np.arange(len(text)) - begin[owner]
        # The first place of each interval: documents by rank, so that one number orders places.
        _, doc = np.unique(some.doc, return_inverse=True)
        place = (doc[owner] << 40) + some.start[owner] + offset
        least = np.minimum.reduceat(place[index.order], index.first) if len(text) else place
        first = (found >= 0) & (place == least[np.maximum(found, 0)])
        who, at, n = ranges_of(first, owner, offset)
        out.append((some.doc[who], some.start[who] + at, n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def dedup_substrings(documents: DataFrame, window: int = WINDOW_WORDS, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` of every row.

    Words are split by ASCII blanks and taken as they are. Every word is removed that
    lies in a run of ``window`` words which also starts earlier: in a document with a
    smaller id, or earlier in the same one. ``kept`` is what is left, joined by single
    blanks (NULL without ``with_text``), ``kept_sha256`` its hash. A NULL text counts
    as empty; texts with fewer words than a window lose nothing. NULL is the last id; rows
    that share an id are documents of their own, in order of a hash of the text, for
    which the table is sorted and written once. An empty table gives no rows; other columns are not read.
    """

    def finish(text: str, start: np.ndarray, length: np.ndarray):
        words = text.encode("utf-8", "surrogatepass").split()
        gone = removed(len(words), window, start, length)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
        return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return dedup_windows(documents, Words, window, lambda p: first_windows(p, window), finish, schema, sole=False)


def without_substrings(documents: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``documents`` with all their columns and ``n_removed``, how many words
    ``dedup_substrings`` removes. A text that loses nothing stays as it is; of another
    one ``text`` is what is left. Rows are not joined, so NULL and repeated ids stay
    rows of their own.
    """
    others = [c for c in documents.columns if c != "text"]
    carry = [F.col("text").isNull(), *[F.col(f"`{c}`") for c in others]]

    def finish(text: str, start: np.ndarray, length: np.ndarray):
        words = text.encode("utf-8", "surrogatepass").split()
        gone = removed(len(words), window, start, length)
        if not gone.any():
            return 0, text
        return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace")

    schema = "doc_id long, n_removed long, kept string"
    found = dedup_windows(documents, Words, window, lambda p: first_windows(p, window), finish, schema, sole=False, carry=carry)
    text = F.when(~F.col("carried.c0"), F.col("kept")).alias("text")
    at = {c: F.col(f"carried.c{i}").alias(c) for i, c in enumerate(others, 1)}
    return found.select(*[at.get(c, text) for c in documents.columns], "n_removed")
