"""Byte-level BPE as a monoid: encode halves, join neighbours.

``Merges.encode`` cuts a piece in two, encodes both and joins the results.
Tokens are a valid encoding exactly if every two neighbours encode to
themselves, so a join re-encodes a window of tokens around the border and
widens it until the pairs at its two edges are valid; all tokens outside were
valid before and stay as they are. Joining is associative, and decoding is
concatenation up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import module_cache

#: Pieces of up to so many bytes are merged directly: the leaves of the tree.
LEAF_BYTES = 24
#: Pieces and words kept per worker, and their longest length.
CACHED, CACHED_CHARS = 700_000, 64


class Merges:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.none = max(self.tokens) + 1  # the rank of what is no token
        self.valid: dict[tuple[int, int], bool] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        ranks, none = self.ranks, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def pair_valid(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) > CACHED:
                self.valid.clear()
            data = self.tokens[a] + self.tokens[b]
            known = self.valid[a, b] = data not in self.ranks and self.leaf(data) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, from the encodings of each."""
        if not left or not right:
            return left + right
        if self.pair_valid(left[-1], right[0]):
            return left + right
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            data = b"".join(self.tokens[t] for t in left[len(left) - i :] + right[:j])
            # The window is longer than its parts, so it may itself go up the tree.
            if len(data) <= 2 * LEAF_BYTES or (i == len(left) and j == len(right)):
                window = self.leaf(data)
            else:
                window = self._window(data)
            before = i == len(left) or self.pair_valid(left[-i - 1], window[0])
            after = j == len(right) or self.pair_valid(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    def _window(self, data: bytes) -> list[int]:
        return self.encode(data)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece, however long. Leaves are joined level by level."""
        if len(data) <= LEAF_BYTES or data in self.ranks:
            return self.leaf(data) if data else []
        level = [self.leaf(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(level) & ~1 :]
        return level[0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, joined up a tree of runs."""
        tokens = self.tokens
        level = [b"".join([tokens[i] for i in ids[at : at + 4096]]) for at in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TextBpe:
    """Encodes whole texts: every match of the pattern is one piece."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merges, self.pattern = Merges(read_ranks(path)), regex.compile(pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        # Where a single blank always begins a match, texts are cut there, and equal
        # words are encoded once.
        probe = "a b 1 ,'s c"
        self.cuts = self.pattern.findall(probe) == ["a", " b", " 1", " ,'", "s", " c"]
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        # Two generations of pieces: what is used again moves to the newer one.
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            ids = self.older.get(text) or tuple(self.merges.encode(text.encode()))
            if len(text) <= CACHED_CHARS:
                if len(self.pieces) > CACHED:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[text] = ids
        return ids

    def word(self, text: str) -> tuple[tuple[int, ...], str]:
        if text[:1] == " " and text[1:].isalpha():  # one match
            ids = self.piece(text)
        else:
            ids = tuple([i for match in self.pattern.findall(text) for i in self.piece(match)])
        return ids, " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by blanks."""
        if not self.cuts:
            ids = [i for match in self.pattern.findall(text) for i in self.piece(match)]
            return ids, " ".join(map(str, ids))
        words = self.cut.split(text) if _odd(text) else text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > CACHED:
                self.words.clear()
            for i, one in enumerate(found):
                if one is None:
                    found[i] = one = self.words.get(words[i]) or self.word(words[i])
                    if len(words[i]) <= CACHED_CHARS:
                        self.words[words[i]] = one
        ids: list[int] = []
        for one in found:
            ids += one[0]
        return ids, " ".join([one[1] for one in found if one[1]])


def _odd(text: str) -> bool:
    """Whether some blank may stand beside another blank character."""
    plain = "  " not in text and "\n " not in text and " \n" not in text
    return not (plain and text[:1] != " " and text[-1:] != " " and text.replace("\n", "").isprintable())


def encode_texts(documents: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)`` of every row.

    Whole texts are encoded by the ranks and decoded again; ``ids`` are NULL without
    ``with_ids``. A NULL text counts as empty, which has no ids. Rows are
    independent: repeated rows give repeated results, a NULL id stays NULL, an empty
    table gives no rows, other columns are not read. Nothing is shuffled.
    """
    chosen = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = module_cache(f"bpe {ranks_path} {pattern}", lambda: TextBpe(ranks_path, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                counts, lists, shas, decoded = [], [], [], []
                for text in some.column("text").to_pylist():
                    ids, decimal = bpe.encode(text)
                    counts.append(len(ids))
                    lists.append(ids if with_ids else None)
                    shas.append(hashlib.sha256(decimal.encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.merges.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array(shas, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return chosen.mapInArrow(
        encode, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    )
