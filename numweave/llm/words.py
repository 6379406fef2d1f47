"""Words of many texts as 64-bit hashes, without a loop over words.

A word is a run of bytes other than the six ASCII blanks. Its hash is a
polynomial over its bytes, taken from one running sum, and then mixed; it
depends on the bytes alone, so every executor gets the same numbers.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15                          # odd, so its powers have inverses modulo 2^64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words per text)."""
    return measured_words(texts)[:2]


def measured_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the number of bytes of every word."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    up, down = _power_tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64),
                            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    h = mix((total[end] - total[begin]) * down[begin])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return h, np.diff(np.searchsorted(begin, np.cumsum(size)), prepend=0), end - begin


def shingle_hashes(h: np.ndarray, words: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words inside a text, number of runs per text);
    a text of 1 to n - 1 words is one run."""
    begin = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    own = np.repeat(np.arange(len(words)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[own]
    stop = np.minimum(at + n, (begin + words)[own])
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for j in range(n):
        out = out * np.uint64(_BASE) + np.where(at + j < stop, padded[at + j], np.uint64(0)) + np.uint64(j)
    return mix(out), count
