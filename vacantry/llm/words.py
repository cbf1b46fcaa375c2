"""Words as hashed numbers, for the operators that learn from texts."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEPT = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_KEPT_DIGITS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None, digits: bool = True) -> list[bytes]:
    """The words of a whole text as UTF-8: ASCII letters lower-cased, other ASCII but letters (and digits) taken as white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEPT_DIGITS if digits else _KEPT).split()


class Hashes(dict):
    """word -> its XXH64; remembers at most `limit` words."""

    def __init__(self, limit: int = 1 << 19):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pairs(first: np.ndarray, second: np.ndarray, kind: int) -> np.ndarray:
    """A hash for each pair of word hashes; `kind` tells neighbours from pairs with a gap."""
    with np.errstate(over="ignore"):
        h = (first * _MIX + np.uint64(kind)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))
        return (h ^ (h >> np.uint64(29))) * _MIX


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
