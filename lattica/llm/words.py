"""Words of UTF-8 buffers and hashes of runs of words, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from lattica.llm.shared import WORD_BYTE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = WORD_BYTE | WORD_BYTE[_LOWER]
#: Bytes of words that are anything between ASCII white space.
UNSPACED = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the n + 1 first words of the documents at ``offsets``.

    A word is a run of ``word_bytes``: digits, letters a-z and bytes outside ASCII if nothing else is said. Documents never share a word.
    """
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word_bytes[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    edges = offsets[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < len(data))])
    cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(low)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words; documents are not told apart here."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * _STEP + words[j : j + n]
        return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n]) if have < width else out[:n]
