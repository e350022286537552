"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words that a memo of hashes holds before it starts anew (about 10 MB).
MEMO = 60_000
SPACE = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def words(text: str) -> list[str]:
    """Words of the text, A-Z lower-cased; six characters part words and no other."""
    text = text.lower() if text.isascii() else text.translate(LOWER)
    if text.isascii() and not _ODD.search(text):
        return text.split()
    return [w for w in SPACE.split(text) if w]


_ODD = re.compile("[\x1c-\x1f]")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Distinct shingles of `size` words of a text; with fewer words, the whole sequence is one; without words, none."""

    def __init__(self, size: int = 5):
        self.size = size
        self.hashes = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        ws = words(text) if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, ws), np.uint64, len(ws))
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = mix(out + h[j : len(h) - k + 1 + j] * _MIX[j % 5])
        return np.unique(out)
