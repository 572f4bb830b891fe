"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

A text is cut where one blank or one line break stands between two non-blank
characters. The pre-tokenizer of such files never matches across that place, so the
pieces encode on their own, and equal pieces, which most are, only once per worker. A text
that holds the string of an added token goes to the library whole, which makes it that token.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

import numpy as np

from tablelens.llm.common import module_cache

_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Pieces kept per worker in each of two generations, unless told otherwise; a million weigh
#: 130 MB or so. Longer pieces are not kept.
CACHED_PIECES, CACHED_CHARS = 1_000_000, 64


def _cut(text: str) -> list[str]:
    """Pieces between the single blanks that stand between two non-blank characters. In texts
    without other blanks, single line breaks cut too; the piece behind one begins with it."""
    plain = "  " not in text and "\n " not in text and " \n" not in text
    if plain and text[:1] != " " and text[-1:] != " " and text.replace("\n", "").isprintable():
        return (text if "\n\n" in text else text.replace("\n", " \n")).split(" ")
    return _CUT.split(text)


class TextEncoder:
    def __init__(self, path: str, cached_pieces: int = CACHED_PIECES) -> None:
        from tokenizers import Tokenizer

        self.cached_pieces = cached_pieces
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # What the cut relies on; other files are encoded whole.
        self.cuts = self.library.encode("a b,\nc").tokens == ["a", "Ġb", ",", "Ċ", "c"]
        self.known: dict[str, bytes] = {}  # by piece, with the blank before it left out
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # Bytes of each token: byte-level tokens have one character for each byte.
        sizes = [(i, len(t)) for t, i in self.library.get_vocab(with_added_tokens=False).items()]
        self.sizes = np.zeros(max(i for i, _ in sizes) + 1, np.int64)
        for i, n in sizes:
            self.sizes[i] = n

    def _after_blank(self, pieces: list[str]) -> list[bytes]:
        """Ids of ``" " + piece`` for each piece, or of the piece if it begins with a line break,
        encoded as one text and cut again."""
        out = []
        for at in range(0, len(pieces), 2_000):
            some = pieces[at : at + 2_000]
            text = " " + " ".join(some)
            plain = text.count(" ") == len(some)  # no piece holds a blank
            text = text.replace(" \n", "\n") if plain else "".join([p if p[0] == "\n" else " " + p for p in some])
            (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            if plain and text.count(" ") + text.count("\n") == len(some):  # line breaks only begin pieces
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                ends = np.append(np.flatnonzero((data == 32) | (data == 10))[1:], len(data))
            else:
                ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + (p[0] != "\n") for p in some])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")
            cuts, data = (cuts * 4).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _library_ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 2_000):
            found = self.library.encode_batch_fast(pieces[at : at + 2_000], add_special_tokens=False)
            out += [np.asarray(e.ids, "<u4").tobytes() for e in found]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known yet, as behind a blank. Letters and the marks after
        them are matched apart by the pre-tokenizer, so they are looked up apart."""
        known, older, marks = self.known, self.older, self.marks
        if len(known) > self.cached_pieces:
            self.older = older = known
            self.known = known = {}
        if len(marks) > self.cached_pieces:
            marks.clear()
        found, wanted, marked, stems = {}, {}, [], []  # lists of strings alone, which no collector walks
        for piece in pieces:
            if older and (ids := older.get(piece)) is not None:
                found[piece] = ids
                continue
            stem = piece.rstrip(_MARKS)
            if not stem or len(stem) == len(piece) or not stem[-1].isalpha():
                wanted[piece] = None
            else:
                marked.append(piece)
                stems.append(stem)
        wanted.update(dict.fromkeys([s for s in stems if s not in known and s not in older and s not in found]))
        found.update(zip(wanted, self._after_blank(list(wanted)), strict=True))
        tails = [p[len(s) :] for p, s in zip(marked, stems, strict=True)]
        fresh = list(dict.fromkeys([t for t in tails if t not in marks]))
        marks.update(zip(fresh, self._library_ids(fresh), strict=True))
        for piece, stem, tail in zip(marked, stems, tails, strict=True):
            found[piece] = (found.get(stem) or known.get(stem) or older[stem]) + marks[tail]
        known.update(found)
        for piece in [p for p in found if len(p) > CACHED_CHARS]:
            del known[piece]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        if not self.cuts:
            return [np.frombuffer(b, "<u4") for b in self._library_ids(texts)]
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            whole = dict(zip(odd, self._library_ids([texts[i] for i in odd]), strict=True))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [np.frombuffer(whole[i], "<u4") if i in whole else next(rest) for i in range(len(texts))]
        cut = [_cut(t) for t in texts]
        pieces = list(chain.from_iterable(cut))
        ends = list(accumulate(map(len, cut)))
        starts = [0, *ends[:-1]]
        ids = list(map(self.known.get, pieces))
        for at, head in zip(starts, self._library_ids([c[0] for c in cut]), strict=True):
            ids[at] = head
        missing = [k for k, i in enumerate(ids) if i is None]
        if missing:
            fresh = self._learn(list(dict.fromkeys([pieces[k] for k in missing])))
            for k in missing:
                ids[k] = fresh[pieces[k]]
        return [np.frombuffer(b"".join(ids[a:b]), "<u4") for a, b in zip(starts, ends, strict=True)]


def encoder_name(path: str) -> str:
    """The encoder's name among the caches of a Python worker."""
    return f"encoder {path}"


def text_encoder(path: str, cached_pieces: int = CACHED_PIECES) -> TextEncoder:
    """The encoder of this Python worker."""
    encoder = module_cache(encoder_name(path), lambda: TextEncoder(path))
    encoder.cached_pieces = cached_pieces
    return encoder


def encoded_in_steps(encoder: TextEncoder, texts: list[str], chars: int = 2_000_000):
    """``(position, ids)`` for each text, a bounded number of characters at a time."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars or i == len(texts) - 1:
            yield from zip(range(start, i + 1), encoder.encode(texts[start : i + 1]), strict=True)
            start, size = i + 1, 0
