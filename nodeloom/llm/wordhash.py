"""Whole texts as arrays of word hashes."""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh64_intdigest

#: Odd factor of the left hash in a joined one.
JOIN = np.uint64(0x9E3779B97F4A7C15)
words_of = re.compile(r"\w+").findall


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit hashes (xor-shift and odd multipliers)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def joined(first: np.ndarray, second: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mixed(first * JOIN + mixed(second + np.uint64(salt)))


def text_words(text: str | None) -> np.ndarray:
    """XXH64 of the words (letters, digits, underscores; lower-cased) of a whole text."""
    found = words_of(text.lower()) if text else []
    return np.fromiter((xxh64_intdigest(w) for w in found), np.uint64, len(found))
