"""Word shingles as 64-bit hashes, computed with numpy on whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_WORDS_AT_ONCE = 200_000  # a text of more words is hashed in overlapping runs, so memory stays bounded


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _run_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the k words from each start, chained over 64-bit hashes of the words."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix((h + each[i : i + n]) * np.uint64(0xD6E8FEB86659FD93))
    return h


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased, words between ASCII white space;
    fewer words than k make one shingle; no word, none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return _run_hashes(words, len(words))
    if len(words) <= _WORDS_AT_ONCE:
        return np.unique(_run_hashes(words, k))
    parts = [np.unique(_run_hashes(words[i : i + _WORDS_AT_ONCE + k - 1], k)) for i in range(0, len(words) - k + 1, _WORDS_AT_ONCE)]
    return np.unique(np.concatenate(parts))


def signature(hashes: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes())
