"""Character n-grams of whole texts as hash buckets, computed for all positions of a slice at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points that one vectorised step handles; longer texts are taken in slices that end between words.
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case code points; whatever is no letter becomes 0."""
    codes = code_points(text.lower())
    return np.where(letter_table()[codes], codes, np.uint32(0))


def slices(codes: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """Pieces of about ``size`` code points, each with a 0 before and after it and cut at zeros.

    A run of letters longer than a slice is cut where the slice ends; nothing is left out.
    """
    start = 0
    edge = np.zeros(1, np.uint32)
    while start < len(codes):
        end = min(len(codes), start + size)
        if end < len(codes):
            zeros = np.flatnonzero(codes[start:end] == 0)
            if len(zeros) and zeros[-1]:
                end = start + int(zeros[-1])
        yield np.concatenate([edge, codes[start:end], edge])
        start = end


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def grams(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n of ``sizes``: the buckets of the n-grams at all positions, and which of them are within a word.

    ``codes`` begins and ends with 0. An n-gram is within a word if only its first and last code point can
    be 0, that is, the edge of a word, and n = 1 takes letters only.
    """
    wide = codes.astype(np.uint64)
    gaps = np.concatenate([[0], np.cumsum(codes == 0)])
    hashes = wide
    for n in range(1, max(sizes) + 1):
        if n > 1:
            hashes = hashes[:-1] * _MULTIPLIER + wide[n - 1 :]
        if n in sizes and len(hashes) > 0:
            start = np.arange(len(hashes))
            if n == 1:
                inside = codes != 0
            elif n == 2:
                inside = (codes[:-1] != 0) | (codes[1:] != 0)
            else:
                inside = gaps[start + n - 1] == gaps[start + 1]
            yield bucket(hashes + np.uint64(n * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF), bits), inside
