"""Document fingerprints: SimHash over word shingles, searched through permuted block tables.

Every occurrence of a term (five consecutive words) votes with its 64 hash bits; a fingerprint's bit is
the sign of its votes. To find all fingerprints within a Hamming radius, the bits are cut into
``radius + 3`` blocks: two fingerprints within the radius agree in at least three of them, so one table
per choice of three blocks, keyed by their bits, holds every pair. Equal fingerprints are one entry.

Neighbours in document order come from a range shuffle and one pass over each sorted partition; only a
partition's first and last text are carried over to the next. Texts are shuffled once.

Defined results: a NULL or empty text has the fingerprint 0 and counts as empty. Rows with equal ids
follow in the order of their texts' hashes, rows without id come first; so different texts of one id, or without
one, are dealt among tasks. A single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolelens.llm import arrays
from rolelens.session import ensure_checkpoint_dir

WORDS = 5
BITS = 64
RADIUS = 3
#: Blocks in which fingerprints within the radius agree; more of them make the tables' keys longer.
AGREEING = 3

#: Texts that are handled in one go.
_ROWS = 512


def fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprints of texts, as unsigned numbers."""
    out = np.zeros(len(texts), np.uint64)
    for block in arrays.word_blocks(texts, arrays.BLANK):
        hashes, counts = arrays.shingles(block, words)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        starts = (np.cumsum(counts) - counts)[full]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        signs = np.packbits(2 * votes > counts[full][:, None], axis=1)
        out[block.first + full] = signs.view(np.uint64).ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b) / BITS


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part int, edge int, text string"
)
#: What a row of the pass is: a finished document, the first of its partition, the last of it.
_DONE, _FIRST, _LAST = 0, 1, 2


def _compared(ids: list, texts: list[str], prints: np.ndarray) -> pa.RecordBatch:
    """Finished rows of all but the last text, each compared with the text after it."""
    own = texts[:-1]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(own, texts[1:], strict=True)]
    changed = fingerprints(pa.array(edited, pa.large_string()))
    n = len(own)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([f"{x:016x}" for x in prints[:-1].tolist()], pa.string()),
            pa.array([f"{x:016x}" for x in changed.tolist()], pa.string()),
            pa.array(likeness(prints[:-1], changed), pa.float64()),
            pa.array(likeness(prints[:-1], prints[1:]), pa.float64()),
            pa.nulls(n, pa.int32()),
            pa.array([_DONE] * n, pa.int32()),
            pa.nulls(n, pa.string()),
        ],
        names=[c.split()[0] for c in _SCHEMA.split(", ")],
    )


def _edge(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
    values = (doc_id, None, None, None, None, None, None, part, kind, text)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
             pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: every text is compared with the next; the last one waits for the next partition."""
    part = TaskContext.get().partitionId()
    ids, texts, prints = [], [], np.zeros(0, np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            more_ids, more = piece.column(0).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
            if not ids and more:
                yield _edge(_FIRST, part, more_ids[0], more[0])
            ids, texts = ids + more_ids, texts + more
            prints = np.append(prints, fingerprints(pa.array(more, pa.large_string())))
            if len(ids) > 1:
                yield _compared(ids, texts, prints)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
    if ids:
        yield _edge(_LAST, part, ids[0], texts[0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text, next text."""
    for batch in batches:
        for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts = [text or "", after or ""]
            yield _compared([doc_id, None], texts, fingerprints(pa.array(texts, pa.large_string())))


def neighbour_fingerprints(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is a row's text with the last quarter replaced by the start of the next document's.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("deal", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "deal")
        .sortWithinPartitions("doc_id", "deal", "text")
        .drop("deal")
    )
    passed = ordered.mapInArrow(_pass, _SCHEMA).checkpoint()
    # one row per partition from here on
    firsts = passed.where(F.col("edge") == _FIRST).select("part", "text")
    lasts = passed.where(F.col("edge") == _LAST).select("part", "doc_id", "text")
    order = Window.orderBy("part")
    around = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = firsts.select("part", F.coalesce(F.lead("part").over(order), around).alias("next"))  # numbers alone
    texts = firsts.select(F.col("part").alias("next"), F.col("text").alias("after"))
    after = follows.join(texts, "next").select("part", "after")
    edges = lasts.join(after, "part").select("doc_id", "text", "after").mapInArrow(_pairs, _SCHEMA)
    return passed.where(F.col("edge") == _DONE).unionByName(edges).drop("part", "edge", "text")


def _masks(radius: int) -> list[int]:
    blocks = radius + AGREEING
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, AGREEING)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column ``print``, long) at most ``radius`` bits apart."""
    # one number stands for a table and its key; should two fall together, the distance still decides
    tables = F.array(*[
        F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(radius))
    ])
    entries = prints.select("print").distinct().select("print", F.explode(tables).alias("key"))
    left, right = entries.alias("l"), entries.alias("r")
    apart = F.bit_count(F.col("l.print").bitwiseXOR(F.col("r.print")))
    return (
        left.join(
            right,
            (F.col("l.key") == F.col("r.key")) & (F.col("l.print") < F.col("r.print")) & (apart <= radius),
        )
        .select(F.col("l.print").alias("a"), F.col("r.print").alias("b"))
        .distinct()
    )


def _number(hexadecimal: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def document_fingerprints(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``neighbour_fingerprints`` and n_near: how many other fingerprints lie within the radius."""
    rows = neighbour_fingerprints(documents).withColumn("print", _number(F.col("fingerprint")))
    pairs = within_radius(rows, radius)
    links = pairs.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count("*").alias("n_near"))
    out = rows.join(links, "print", "left").drop("print")
    return out.withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
