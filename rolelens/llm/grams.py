"""Exact names of word sequences within one text.

Words are bytes between ASCII white space; every sequence of k words gets a number, equal for equal
sequences only. Numbers of longer sequences are made from pairs of shorter ones, so nothing is hashed.
"""

from __future__ import annotations

import numpy as np


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number per word, by first appearance."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def pair_codes(codes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A number per pair of equal places; both arrays hold numbers below their texts' lengths."""
    if not len(codes):
        return codes[:0]
    return np.unique(codes * (int(other.max()) + 1) + other, return_inverse=True)[1].astype(np.int64)


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A number per start of ``k`` consecutive words; empty for shorter texts."""
    if len(codes) < k:
        return codes[:0]
    if k == 1:
        return codes
    half = gram_codes(codes, k // 2)
    both = pair_codes(half[: len(half) - k // 2], half[k // 2 :])
    return pair_codes(both[:-1], codes[k - 1 :]) if k % 2 else both
