"""Packing by power-of-two decomposition: no sequence holds parts of two documents.

A document of n tokens is cut into whole pieces of ``LONGEST`` tokens and one piece for each binary digit
of what is left, longest first. Each piece is a sequence of its own, and pieces of equal length share a
bucket. A task draws batches from its buckets: as soon as one holds ``BATCH_TOKENS`` tokens, its sequences
come out together under one ``batch_id``, so a batch has one length and nothing is padded; what is left at
the end of a task makes smaller batches.

Everything is decided in one pass over the texts: no shuffle, and a task holds a few hundred texts and at
most one open batch per length at a time. This tokenizer works on words, which never share a token, so the
ids of words, and of what stands between blanks, are kept by the worker process for this and its next tasks,
in two generations: when the young one is full it replaces the old one, and texts in use come back from there. Texts with
other than Latin characters, or with special tokens, go through the tokenizer as a whole.

Defined results: a NULL or empty text has only the end token, one piece of length 1. Repeated rows are
packed one by one, each with sequences of its own. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 2048
END_ID = 1
#: Tokens of one batch of equal sequences.
BATCH_TOKENS = 1 << 16
#: Texts of one generation of a cache; there is one for words and one for what stands between blanks.
CACHED = 200_000
#: Longer words are not kept.
_KEPT_CHARS = 64
#: Texts that are handled in one go.
_ROWS = 256

#: Characters for which lower-casing is by character and composition changes nothing.
_LATIN = [chr(i) for i in range(0x250)]
#: Python takes the four separators from 0x1C on for blanks, the tokenizer does not.
_ODD_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_NOT_LATIN = re.compile(f"[^{_LATIN[0]}-{_LATIN[-1]}]|\u0130|{'|'.join(map(re.escape, _ODD_ASCII))}")


#: The module under which a process keeps its encoders.
_KEPT = "rolelens_encoders"


def _word_pattern() -> re.Pattern[str]:
    """The words that the tokenizer's own splitting finds in lower-cased Latin text."""

    def of(kind: str) -> str:
        return re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind))

    blank = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    return re.compile(rf"[{of('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{of('N')}]|[^{blank}{of('L')}{of('N')}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, then upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class _Kept(dict):
    """What ``make`` makes of a text, kept for two generations of ``CACHED`` texts."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= _KEPT_CHARS:
            self[text] = found
        return found

    def grow_old(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Token ids of texts, as little-endian 32-bit numbers, by the word tokenizer file at ``path``."""
    from tokenizers import Tokenizer

    # a task's functions are its own; a module is what lasts as long as the process
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if path in kept:
        return kept[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are parallel already
    tokenizer = Tokenizer.from_file(path)
    words_of = _word_pattern().findall
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()

    def word_ids(word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # those stand for themselves
            word = word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(word)]).tobytes()

    words = _Kept(word_ids)
    # words never reach over blanks, so that most of a text is looked up by what stands between blanks
    chunks = _Kept(lambda c: words[c] if c.isalpha() else b"".join([words[w] for w in words_of(c)]))

    def encode(texts: list[str]) -> list[bytes]:
        plain = [t.isascii() and not any(m in t for m in _ODD_ASCII) or not _NOT_LATIN.search(t) for t in texts]
        found = tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False)
        whole = iter([np.array(e.ids, "<u4").tobytes() for e in found])
        words.grow_old()
        chunks.grow_old()
        latin = (b"".join([chunks[c] for c in t.lower().split()]) for t, p in zip(texts, plain, strict=True) if p)
        return [next(latin if p else whole) for p in plain]

    kept[path] = encode
    return encode


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Whole pieces, then the binary digits of the rest, longest first. ``longest`` is a power of two."""
    rest = tokens % longest
    digits = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return [longest] * (tokens // longest) + digits


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "batch_id")
#: Batches of a task and a length; bits below the task's number in a batch_id.
_BATCH_BITS = 36


class _Buckets:
    """The open batch of each length, and how many batches of it this task has drawn."""

    def __init__(self, task: int, id_type: pa.DataType):
        self.task, self.kinds = task, [id_type, *[pa.int64()] * 4, pa.binary(), pa.int64()]
        self.open: dict[int, list[tuple]] = {}
        self.drawn: dict[int, int] = {}

    def add(self, piece: tuple) -> Iterator[pa.RecordBatch]:
        length = piece[2]
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) * length >= BATCH_TOKENS:
            yield self._batch(length)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for length in sorted(self.open, reverse=True):
            if self.open[length]:
                yield self._batch(length)

    def _batch(self, length: int) -> pa.RecordBatch:
        number = self.drawn.get(length, 0)
        self.drawn[length] = number + 1
        held, self.open[length] = self.open[length], []
        # bits of the length's exponent, then the number within the task and length
        batch = (self.task << _BATCH_BITS) + (length.bit_length() << (_BATCH_BITS - 5)) + number
        columns = [*zip(*held, strict=True), [batch] * len(held)]
        made = [pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, names=list(_COLUMNS))


def pieces(documents: DataFrame, tokenizer_path: str, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch_id, ids.

    ``ids`` are the piece's token ids, little-endian 32-bit numbers; NULL without ``with_ids``. The rows of a
    batch follow each other; all have one length.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        buckets = None
        for batch in batches:
            if buckets is None:
                buckets = _Buckets(TaskContext.get().partitionId(), batch.schema.field(0).type)
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    start, tokens = 0, len(ids) // 4
                    for length in piece_lengths(tokens, longest):
                        own = ids[4 * start : 4 * (start + length)]
                        kept = own if with_ids else None
                        yield from buckets.add((doc_id, start, length, zlib.crc32(own), tokens, kept))
                        start += length
        if buckets is not None:
            yield from buckets.rest()

    id_type = documents.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _COLUMNS[1:5])
    cut = documents.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, {numbers}, ids binary, batch_id long")
    return cut.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "batch_id",
        "ids",
    )


def buckets(packed: DataFrame) -> DataFrame:
    """How many sequences, tokens and batches each length has: length, sequences, tokens, batches.

    Batches are counted per batch first, so that no distinct values are gathered per length.
    """
    drawn = packed.groupBy("length", "batch_id").agg(F.count("*").alias("n"))
    return drawn.groupBy("length").agg(
        F.sum("n").alias("sequences"), F.sum(F.col("n") * F.col("length")).alias("tokens"), F.count("*").alias("batches")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder per length, batches in order within a task's file.

    A task keeps its rows, so a length that most sequences have is spread over all tasks.
    """
    packed.sortWithinPartitions("length", "batch_id").write.partitionBy("length").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length; no other folder is read."""
    return spark.read.parquet(path).where(F.col("length") == length)
