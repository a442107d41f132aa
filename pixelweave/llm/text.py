"""Words and hashes shared by the text operators.

Texts reach Python as UTF-8 bytes. ``bytes.split`` separates exactly at space
and 0x09-0x0D and ``bytes.lower`` changes exactly A-Z, so the word rules of the
operators are two C calls per text.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, functions as F

WORD_REGEX = r"[^\x20\x09-\x0D]+"
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def as_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes."""
    return F.col(column).cast("string").cast("binary")


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between white space, unchanged."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-case runs of a-z, 0-9 and every character beyond ASCII."""
    return text.lower().translate(_KEEP).split() if text else []


class WordHash(dict):
    """64-bit word hashes, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; all words as one run if there are fewer."""
    k = min(k, len(h))
    if k == 0:
        return h
    n = len(h) - k + 1
    g = np.full(n, k, np.uint64)
    for i in range(k):
        g = mix(g * _STEP + h[i:i + n])
    return g
