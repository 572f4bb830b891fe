"""Hashed words and grams of whole texts, for use inside tasks."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from tablelens.llm.common import module_cache

#: Words whose hash a worker remembers at most.
CACHED_WORDS = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    known = module_cache("word hashes", _Hashes)
    if len(known) >= CACHED_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items; none for fewer items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return total


def sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` consecutive values."""
    reach, out = 1, values
    while reach < window:
        step = min(reach, window - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes of the word k-grams of a text, A to Z in lower case;
    a text of fewer words is one gram, one without words has none."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(k, len(h))))
