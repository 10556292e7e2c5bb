"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Only ASCII bytes separate words, so bytes from 0x80 on always belong to one, and words can be found
without decoding. Texts go through in blocks of bounded size; one longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ASCII = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that stand between words: ASCII white space, or all ASCII apart from digits and letters.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = _ASCII < 128
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Bytes of text that are handled in one go.
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Word hashes of the texts ``first`` to ``first + len(counts) - 1``, one after the other."""

    first: int
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; NULL is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_blocks(texts: pa.Array, separators: np.ndarray, prefix: int | None = None) -> Iterator[Words]:
    """The lower-cased (A-Z) words of all texts, hashed, block by block.

    With ``prefix`` only that many first bytes of each word count.
    """
    data, offsets = utf8(texts)
    for first, last in blocks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        yield Words(first, *_words(data[offsets[first] : offsets[last]], own, separators, prefix))


def _words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, prefix: int | None
) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]  # a word ends with its text
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    place = np.flatnonzero(inside)
    letters = _LOWER[data[place]].astype(np.uint64) + np.uint64(1)
    order = np.flatnonzero(begins[place])  # each word's first byte among the words' bytes
    sizes = np.diff(np.append(order, len(place)))
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _BASE, np.uint64))
    if prefix is not None:
        powers[prefix:] = 0
    letters *= powers[np.arange(len(place)) - np.repeat(order, sizes)]
    hashes = mix(np.add.reduceat(letters, order))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their count per text.

    A text with fewer words, but not none, has one shingle of all its words.
    """
    h, counts = words.hashes, words.counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    short = np.where((counts > 0) & (counts < size), counts, size)
    total = int(made.sum())
    if not total:
        return np.zeros(0, np.uint64), made
    base = np.repeat(words.starts, made) + np.arange(total) - np.repeat(np.cumsum(made) - made, made)
    length = np.repeat(short, made)
    out = np.zeros(total, np.uint64)
    for k in range(size):
        with_word = length > k
        word = h[np.minimum(base + k, len(h) - 1)]
        out = np.where(with_word, mix(out * _BASE + word), out)
    return mix(out + length.astype(np.uint64)), made
