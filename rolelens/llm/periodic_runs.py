"""Periodic runs of words by seed and extension along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length
of at least max(6, 4 q) that no neighbouring word extends. Words of a run so equal those q further on for
at least max(6, 4 q) - q places. That overlap bounds the seeds: sequences of k words are indexed for
k = 5, 15, 45 ..., and each k serves the periods up to k that the one before does not, whose guaranteed
overlap is k or more. Two occurrences of one sequence lie on the diagonal of their distance, the lag.

Only neighbouring occurrences are paired, so a sequence that fills a text gives one pair per place and
not all pairs. Nothing is lost: if k >= q and a sequence of k words within a run came back sooner than
after q words, the run would have a period below q (Fine and Wilf). Per lag, the furthest place covered so
far suppresses every seed inside a stretch that is already known; the others are extended word by word.

All of this happens within one text, so there is no shuffle, and a task holds one batch of texts.

Defined results: NULL and empty texts have no words and no run. A row without doc_id is not edited.
Repeated rows are answered one by one; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolelens.llm import arrays, grams

FIRST_SEED = 5  # max(6, 4 q) - q is at least 5 for every q
MIN_WORDS = 6
MIN_PERIODS = 4


def needed(period):
    """Length of the shortest run of a period (a number or an array)."""
    return np.maximum(MIN_WORDS, MIN_PERIODS * period)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of both arrays are equal, looked at in growing steps."""
    size, step, at = min(len(a), len(b)), 16, 0
    while at < size:
        differs = a[at : min(at + step, size)] != b[at : min(at + step, size)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, 2 * step
    return size


def _seeds(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each sequence that comes back, with the lag to its next occurrence, by lag and place."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    place = order[:-1][same]
    lag = order[1:][same] - place
    by = np.lexsort((place, lag))
    return place[by], lag[by]


def _extended(codes: np.ndarray, place: np.ndarray, lag: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The runs around the seeds, which are ordered by lag and place."""
    if not len(place):
        return []
    # seeds that overlap the one before on their diagonal belong to its stretch
    opens = np.ones(len(place), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k)
    heads = np.flatnonzero(opens)
    lasts = np.append(heads[1:], len(place)) - 1
    # a stretch covers at least what its seeds cover, and every place of a run is a seed up to its last k words
    long_enough = place[lasts] + k - place[heads] + lag[heads] >= needed(lag[heads])
    furthest: dict[int, int] = {}
    found = []
    for at, period in zip(place[heads[long_enough]].tolist(), lag[heads[long_enough]].tolist(), strict=True):
        if at < furthest.get(period, -1):
            continue
        end = at + period + _agreeing(codes[at:-period], codes[at + period :])
        start = at - _agreeing(codes[:at][::-1], codes[period : at + period][::-1])
        furthest[period] = end - period
        if end - start >= needed(period):
            found.append((start, end - start, period))
    return found


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period. ``codes`` name its words."""
    done, k = 0, FIRST_SEED
    found: list[tuple[int, int, int]] = []
    names = grams.gram_codes(codes, k)
    while True:
        place, lag = _seeds(names)
        served = (lag > done) & (lag <= k)
        found += _extended(codes, place[served], lag[served], k)
        # no sequence comes back, so no longer one does; or the next periods are too long for the text
        if not len(place) or MIN_PERIODS * (k + 1) > len(codes):
            return sorted(found, key=lambda r: (r[0], r[2]))
        first = grams.pair_codes(names[: -2 * k], names[k:-k])
        names = grams.pair_codes(first, names[2 * k :])
        done, k = k, 3 * k


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The text that the query looks at: in a tenth of the documents, by id, the end repeats periodically."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change)
    return [w for w, k in zip(words, inside.tolist()) if not k]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the shortest period. Exact."""
    top = None
    for run in found:  # by start, then period
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def _digest(doc_id: int | None, text: bytes, edit: bool) -> tuple:
    words = text.split()  # bytes split at ASCII white space alone
    if edit:
        words = edited(words, doc_id)
    found = runs(grams.word_codes(words))
    top = best(found)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id,
        len(found),
        *(top or (None, None, None)),
        top and 1000 * top[1] // top[2],
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
        len(words),
        found,
    )


_COLUMNS = ["n_runs long", "start long", "length long", "period long", "exponent_milli long",
            "runs_sha256 string", "collapsed_sha256 string", "n_words long"]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(documents: DataFrame, edit: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the best run, digests of all runs and of the collapsed text, n_words, runs.

    ``runs`` lists (start, length, period). With ``edit`` the texts are edited first, as the query asks.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *_COLUMNS, "runs array<struct<start:long,length:long,period:long>>"])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.list_(_RUN)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            ids = batch.column(0)
            out = [_digest(i, t or b"", edit) for i, t in zip(ids.to_pylist(), texts, strict=True)]
            columns = list(zip(*out, strict=True))[1:]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [c.split()[0] for c in _COLUMNS]
            yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", *names, "runs"])

    return documents.select("doc_id", "text").mapInArrow(rows, schema)


def collapse(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with each periodic run cut to its first period; NULL stays NULL.

    Texts with a run come back with single spaces between words, the others as they are.
    """
    at, kept = documents.columns.index("text"), documents.schema

    def shortened(text: bytes | None) -> bytes | None:
        words = (text or b"").split()
        found = runs(grams.word_codes(words))
        return b" ".join(collapsed(words, found)) if found else text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            text = batch.column(at)
            new = [shortened(t) for t in text.cast(pa.large_binary()).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(text.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(rows, kept)
