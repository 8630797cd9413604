"""Words: maximal runs of letters and digits (categories L and N) of the lower-cased text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
#: ASCII that is neither letter nor digit becomes a space.
_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(text: str | None) -> list[str]:
    """The words of a text; none for null. Same result as WORD.findall(text.lower())."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return text.translate(_ASCII).split()
    return WORD.findall(text)


_known: dict[str, int] = {}


def word_hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes, kept for words that were seen before."""
    try:
        return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        if len(_known) > 1_000_000:
            _known.clear()
        for word in found:
            if word not in _known:
                _known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
            out ^= out >> np.uint64(29)
    return out
