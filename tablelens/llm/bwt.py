"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

Letters are blocks of ``window / ROUNDS`` bytes, taken at every place, so the suffix
at a place is the row of blocks from there on, and the letter before it is the
block that ends there. The pieces of a bucket are dealt over shards; each shard
sorts its own suffixes and keeps its transform. The merge never sorts suffixes
again: it keeps for each row only the shard it comes from, and refines this
interleave. A round sends every row to the block of its letter, in order, which
sorts the merged rows by one letter more; rows that were told apart before, or
whose letters differ, get a border. After ROUNDS rounds the rows between two
borders share a common prefix of ``window`` bytes: the repeated intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tablelens.llm.windows import Bytes, Pieces, dedup_windows, eights, ranges_of, removed, sub_indexes
from tablelens.llm.words import mixed

WINDOW_BYTES, ROUNDS, SHARDS = 400, 4, 4
_STOP = 0


class Strings:
    """Pieces laid out one behind the other, each with one more place for its end."""

    def __init__(self, contents: list[bytes], block: int) -> None:
        size = np.fromiter(map(len, contents), np.int64, len(contents)) + 1
        self.owner = np.repeat(np.arange(len(size)), size)
        self.offset = np.arange(len(self.owner)) - (np.cumsum(size) - size)[self.owner]
        self.left = size[self.owner] - 1 - self.offset  # bytes from here to the end of the piece
        self.whole = self.left >= block  # a letter starts here; elsewhere a suffix ends
        n = len(self.owner)
        eight = eights(b"\0".join(contents) + bytes(block + 9))
        h = np.zeros(n, np.uint64)
        for at in [*range(0, block - 8, 8), block - 8]:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + eight[at : at + n])
        _, letters = np.unique(h, return_inverse=True)
        self.letters = letters.astype(np.int64) + 1
        self.before = np.where(self.offset >= block, self.letters[np.arange(n) - block], _STOP)


class ShardTransform:
    """The suffixes of some pieces, sorted, and the letter before each. An end is unlike
    every other, so all suffixes differ."""

    def __init__(self, strings: Strings, places: np.ndarray, block: int) -> None:
        n, whole, left = len(places), strings.whole[places], strings.left[places]
        at = np.empty(len(strings.owner), np.int64)
        at[places] = np.arange(n)
        self.ends = int((~whole).sum())
        # The rank of a suffix is where its group begins. By the first letter, then by 1, 2,
        # 4, ... letters more, in each round only those that are not alone yet.
        rank, active = np.zeros(n, np.int64), np.arange(n)
        key, reach = np.where(whole, strings.letters[places] + n, np.cumsum(~whole)), block
        while True:
            order = np.argsort(key)
            active, key, old = active[order], key[order], rank[active[order]]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([new, [len(key)]]))
            group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            begin = group[np.searchsorted(group, new, side="right") - 1]
            rank[active] = np.repeat(old[new] + new - begin, size)
            active = active[np.repeat(size > 1, size)]
            if not len(active):
                break
            far = left[active] >= reach
            after = np.zeros(len(active), np.int64)
            after[far] = rank[at[places[active[far]] + reach]] + 1
            key, reach = rank[active] * (n + 2) + after, 2 * reach
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.places = places[order]
        self.letters = strings.before[self.places]


def merged_groups(shards: list[ShardTransform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave after ``rounds`` rounds as places in merged order, and the number of
    the common-prefix interval of each."""
    ends = np.repeat(np.arange(len(shards)), [s.ends for s in shards])
    interleave = np.repeat(np.arange(len(shards)), [len(s.places) for s in shards])
    n = len(interleave)
    group = np.zeros(n, np.int64)

    def spread(values: list[np.ndarray]) -> np.ndarray:
        out = np.empty(n, np.int64)
        for i, v in enumerate(values):
            out[interleave == i] = v
        return out

    for _ in range(rounds):
        letter = spread([s.letters for s in shards])
        live = np.flatnonzero(letter != _STOP)
        order = np.sort(letter[live] * n + live) % n  # by letter, and in the old order within
        now, old = letter[order], group[order]
        border = np.ones(len(order), bool)
        border[1:] = (now[1:] != now[:-1]) | (old[1:] != old[:-1])
        interleave = np.concatenate([ends, interleave[order]])
        # Every end is an interval of its own.
        group = np.concatenate([np.arange(len(ends)), len(ends) - 1 + np.cumsum(border)])
    return spread([s.places for s in shards]), group


def repeated_places(contents: list[bytes], weight: np.ndarray, window: int, rounds: int = ROUNDS, shards: int = SHARDS):
    """For the distinct strings ``contents``, which occur ``weight`` times: owner, offset
    and total weight of each place from which ``window`` bytes follow."""
    block, shards = window // rounds, min(shards, len(contents))
    s = Strings(contents, block)
    of = s.owner % shards
    places, group = merged_groups([ShardTransform(s, np.flatnonzero(of == k), block) for k in range(shards)], rounds)
    sums = np.bincount(group, weight[s.owner[places]])
    full = s.left[places] >= window
    at, total = places[full], sums[group[full]]
    order = np.argsort(at)
    return s.owner[at][order], s.offset[at][order], total[order]


def sole_windows(pieces: Pieces, window: int):
    """The windows that occur once, as ranges ``(doc, start, n)``. Pieces that are alone
    with their anchor and hold it once repeat nothing; an equal piece repeats all."""
    _, group, total = np.unique(pieces.anchor, return_inverse=True, return_counts=True)
    shared = (total[group] > 1) | pieces.inner
    shared = np.bincount(group, shared, len(total))[group] > 0
    alone = np.flatnonzero(~shared & ~pieces.often)
    out = [(pieces.doc[alone], pieces.start[alone], pieces.windows[alone])]
    for rows in sub_indexes(pieces, np.flatnonzero(shared), window):
        some = pieces.take(rows)
        owner, offset, weight = repeated_places(some.content, 1.0 + some.often, window)
        who, at, n = ranges_of(weight == 1, owner, offset)
        out.append((some.doc[who], some.start[who] + at, n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def dedup_bytes(documents: DataFrame, window: int = WINDOW_BYTES, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row.

    Texts are their UTF-8 bytes. Every byte is removed that lies in a string of
    ``window`` bytes which also starts anywhere else, in any document; ``n_spans`` are
    the maximal runs removed. ``kept`` is what is left, with bytes that no longer make
    a character replaced (NULL without ``with_text``); ``kept_sha256`` is of the exact
    bytes. ``window`` is a multiple of 4, 64 at least. A NULL text counts as empty;
    shorter texts lose nothing. Rows that share an id, or have none, are documents of
    their own; the table is sorted and written once to tell them apart. An empty table gives no rows; other columns are not read.
    """
    if window % ROUNDS or window < 16 * ROUNDS:
        raise ValueError(f"the window must be a multiple of {ROUNDS}, {16 * ROUNDS} at least")

    def finish(text: str, start: np.ndarray, length: np.ndarray):
        data = text.encode("utf-8", "surrogatepass")
        gone = removed(len(data), window, start, length)
        kept, spans = data, 0
        if gone.any():
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return dedup_windows(documents, Bytes, window, lambda p: sole_windows(p, window), finish, schema, sole=True)
