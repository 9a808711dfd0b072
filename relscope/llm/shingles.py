"""Sets of word shingles as sorted 64-bit hashes, for a batch of texts at once.

Words are maximal runs of bytes other than blanks and U+0009 to U+000D, with A to Z in lower
case.  A word's hash is a polynomial of its bytes, read off prefix sums, and mixed; a
shingle's hash is one of its words'.  Sets are compared by these hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_SEED = 0xD1342543DE82EF95

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    out = []
    for base in (_ODD, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words of each text."""
    joined = b"\n".join(texts) + b"\n"
    letters = _LOWER[np.frombuffer(joined, np.uint8)]
    space = _SPACE[letters]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(1 << max(16, int(len(letters)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)], dtype=np.uint64)])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's set as sorted int64 hashes.

    A text with fewer words than ``n`` has its whole sequence as one shingle; one without
    words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, np.int64) for _ in texts]
    folded = np.full(len(words), _SEED, np.uint64)
    by_length = {}
    for k in range(1, n + 1):
        m = len(words) - k + 1
        if m <= 0:
            break
        folded[:m] = folded[:m] * np.uint64(_ODD) + words[k - 1 :]
        by_length[k] = mix(folded[:m] + np.uint64(k)) if k == n or (counts == k).any() else None
    out, at = [], 0
    for c in counts.tolist():
        k = min(c, n)
        out.append(np.unique(by_length[k][at : at + c - k + 1].view(np.int64)) if c else np.zeros(0, np.int64))
        at += c
    return out
