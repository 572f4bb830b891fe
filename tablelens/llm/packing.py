"""Packing by vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, segments (one) and loss-bearing tokens. Open
sequences have what is left of each limit. The next item goes where the dot
product of its sizes and what is left there, both as shares of the limits, is
largest among the sequences it fits; if none, into a new one. Texts may be cut
anywhere, so whole sequences are cut off long texts first, and an item that
fits nowhere while the sequences open are at their bound is cut to fill the
fullest of them.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import released
from tablelens.llm.encoding import CACHED_PIECES, encoded_in_steps, encoder_name, text_encoder

#: Rows whose texts a task holds as strings at a time.
SLICE_ROWS = 256


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most, and how many sequences a task keeps open."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    open_sequences: int = 64


class VectorPacker:
    """Packs a stream of examples. ``add`` gives the pieces placed so far as
    ``(item, start, length, sequence, offset)``; ``close`` settles what is open."""

    def __init__(self, limits: Limits, first_sequence: int = 0) -> None:
        if min(limits.tokens, limits.segments, limits.loss_tokens, limits.open_sequences) < 1:
            raise ValueError("every limit must be at least one")
        self.most, self.next = limits, first_sequence
        n = limits.open_sequences
        self.scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.left = np.zeros((n, 3), np.int64)  # tokens, segments, loss tokens left
        self.names = np.full(n, -1, np.int64)

    def _open(self, slot: int) -> None:
        self.names[slot] = self.next
        self.next += 1
        self.left[slot] = (self.most.tokens, self.most.segments, self.most.loss_tokens)

    def _place(self, slot: int, item, start: int, length: int, loss: int):
        piece = (item, start, length, int(self.names[slot]), int(self.most.tokens - self.left[slot, 0]))
        self.left[slot] -= (length, 1, loss)
        if self.left[slot].min() <= 0:
            self.names[slot] = -1
        return piece

    def add(self, item, loss: np.ndarray) -> Iterator[tuple]:
        """``loss`` has one flag for each token of the item."""
        n, start = len(loss), 0
        paid = np.arange(n + 1) if loss.all() else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])
        while start < n:
            length, bearing = n - start, int(paid[n] - paid[start])
            is_open = self.names >= 0
            if length <= self.most.tokens:
                fits = np.flatnonzero(
                    is_open & (self.left[:, 0] >= length) & (self.left[:, 1] >= 1) & (self.left[:, 2] >= bearing)
                )
                if len(fits):
                    value = (self.left[fits] / self.scale) @ (np.array([length, 1, bearing]) / self.scale)
                    best = fits[value == value.max()]
                    # Of equal values the sequence opened first.
                    slot = int(best[0] if len(best) == 1 else best[self.names[best].argmin()])
                    yield self._place(slot, item, start, length, bearing)
                    return
            if length <= self.most.tokens and bearing <= self.most.loss_tokens and not is_open.all():
                slot = int(np.flatnonzero(~is_open)[0])
                self._open(slot)
                continue
            if not is_open.any() or (length > self.most.tokens and not is_open.all()):
                slot = int(np.flatnonzero(~is_open)[0])
                self._open(slot)
            else:  # fill the open one with the fewest tokens left
                held = np.flatnonzero(is_open)
                slot = int(held[np.lexsort((self.names[held], self.left[held, 0]))[0]])
            # As many tokens as both limits allow; a piece without loss needs no loss room.
            end = min(n, start + int(self.left[slot, 0]))
            end = min(end, int(np.searchsorted(paid, paid[start] + self.left[slot, 2], side="right")) - 1)
            yield self._place(slot, item, start, end - start, int(paid[end] - paid[start]))
            start = end

    def open_fill(self) -> list[tuple[int, int]]:
        """``(sequence, tokens in it)`` of the sequences still open."""
        held = self.names >= 0
        return list(zip(self.names[held].tolist(), (self.most.tokens - self.left[held, 0]).tolist(), strict=True))


def _settle(packer: VectorPacker, held: dict[int, list[tuple]]) -> Iterator[tuple]:
    """The pieces of sequences that stayed open. The fullest sequence keeps what is in it and is
    completed with cuts from the emptiest, again by the largest dot product with what is left in
    it, and so on until one is left, which ``_powers`` divides."""
    most = packer.most
    scale = packer.scale
    open_ = sorted(held.items(), key=lambda x: (-sum(p[2] for p in x[1]), x[0]))
    waiting = deque((name, [(item, start, n, loss) for item, start, n, _, _, loss in ps]) for name, ps in open_)
    while len(waiting) > 1:
        name, pieces = waiting.popleft()
        offset, paid = 0, 0
        for item, start, n, loss in pieces:
            yield item, start, n, name, offset
            offset, paid = offset + n, paid + int(loss.sum())
        left = np.array([most.tokens - offset, most.segments - len(pieces), most.loss_tokens - paid])
        while left.min() > 0 and waiting:
            donor = waiting[-1][1]
            sizes = np.array([[min(n, left[0]), 1, min(int(loss.sum()), left[2])] for _, _, n, loss in donor])
            best = int(((sizes / scale) @ (left / scale)).argmax())
            item, start, n, loss = donor[best]
            take = min(n, int(left[0]), int(np.searchsorted(np.cumsum(loss), left[2], side="right")))
            yield item, start, take, name, offset
            offset += take
            left -= (take, 1, int(loss[:take].sum()))
            if take < n:
                donor[best] = (item, start + take, n - take, loss[take:])
            else:
                del donor[best]
                if not donor:
                    waiting.pop()
    if waiting:
        yield from _powers(packer, waiting[0][1])


def _powers(packer: VectorPacker, pieces: list[tuple]) -> Iterator[tuple]:
    """Pieces laid end to end in sequences whose lengths are the powers of two that make up
    their total, which need no padding. The limits on segments and loss are kept
    by starting a further sequence, cut again at powers of two."""
    most = packer.most
    total = sum(p[2] for p in pieces)
    room = segments = loss_room = 0
    offset = name = 0
    for item, start, length, loss in pieces:
        done = 0
        while done < length:
            if not room or not segments or not loss_room:
                top = most.tokens if total >= most.tokens else 1 << (total.bit_length() - 1)
                room, segments, loss_room, offset = top, most.segments, most.loss_tokens, 0
                name, packer.next = packer.next, packer.next + 1
            take = min(room, length - done)
            flags = loss[done : done + take]
            paid = np.cumsum(flags)
            if len(paid) and paid[-1] > loss_room:
                take = int(np.searchsorted(paid, loss_room, side="right"))
            bearing = int(np.sum(flags[:take]))
            yield item, start + done, take, name, offset
            done, offset, total = done + take, offset + take, total - take
            room, segments, loss_room = room - take, segments - 1, loss_room - bearing


def pack_stream(
    examples: Iterator[tuple[object, np.ndarray]], limits: Limits, first_sequence: int
) -> Iterator[tuple]:
    """``(item, start, length, sequence, offset)`` for every piece of ``(item, loss
    flags)``. Only the pieces of open sequences are held, so memory follows
    ``limits``. An example without tokens has no piece."""
    packer, held = VectorPacker(limits, first_sequence), {}
    for item, loss in examples:
        for piece in packer.add(item, loss):
            _, start, length, name, _ = piece
            held.setdefault(name, []).append((*piece, loss[start : start + length]))
            if name not in packer.names:
                yield from (p[:5] for p in held.pop(name))
    yield from _settle(packer, held)


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long, ids binary"
)


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    limits: Limits = Limits(),
    with_ids: bool = True,
    prompt: str | None = None,
    cached_pieces: int = CACHED_PIECES,
) -> DataFrame:
    """One row per piece: its document, place in it, sequence and offset there, ids
    as little-endian unsigned 32-bit integers and their crc32.

    A document is the ids of its whole text and ``end_id``. All tokens bear loss,
    or, where ``prompt`` names a column with a number of leading characters, all but
    those of that many characters' encoding. Each task packs the rows it reads, so
    nothing is shuffled; ``sequence_id`` holds the partition in its upper 24 bits.
    A NULL or empty text is its end id alone; NULL ids stay NULL; repeated rows are
    packed each; an empty table gives no rows; other columns are not read. A worker remembers
    the ids of twice ``cached_pieces`` pieces of texts or so; fewer take less memory and more time.
    """
    chosen = documents.select(
        F.col("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        (F.coalesce(F.col(f"`{prompt}`").cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")).alias("prompt"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, cached_pieces)
        first = TaskContext.get().partitionId() << 39

        def examples():
            for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
                ids, texts, prompts = (batch.column(c).to_pylist() for c in range(3))
                for i, found in encoded_in_steps(encoder, texts):
                    tokens = np.append(found, np.uint32(end_id)).astype("<u4")
                    loss = np.ones(len(tokens), np.int8)
                    if prompts[i] > 0:
                        head = encoder.encode([texts[i][: prompts[i]]])[0]
                        loss[: min(len(head), len(found))] = 0
                    yield (ids[i], tokens, loss), loss

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[8], pa.binary())], [*names, "ids"])

        rows = []
        for (doc, tokens, loss), start, length, name, offset in pack_stream(examples(), limits, first):
            data = tokens[start : start + length].tobytes()
            bearing = int(loss[start : start + length].sum())
            rows.append((doc, start, length, zlib.crc32(data), len(tokens), name, offset, bearing, data if with_ids else None))
            if len(rows) >= 2_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return chosen.mapInArrow(lambda b: released(pack(b), keep=encoder_name(tokenizer)), SCHEMA)
