"""Word and word-gram columns built from SQL functions alone, and small table helpers.

Words are arrays in reading order. Grams are built by doubling: the hashes of 2, 4, 8 ... words are
combined from two neighbours each, so a gram of ten words costs a few passes over the word hashes
instead of ten words hashed at every position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Everything that separates words: ASCII apart from digits and letters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_array(c: Column) -> Column:
    """Lower-cased words of a text; an empty array for NULL."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NON_WORD), "")


def hash_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A plain column would be inlined by the optimizer, and inside a lambda that means once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(
    hashes: Column, lengths: list[int], body: Callable[[dict[int, Column]], Column]
) -> Column:
    """``body`` of {n: hashes of all n consecutive words, by start}; shorter texts have empty arrays.

    ``hashes`` are the word hashes, already bound by ``let`` or a stored column.
    """

    def doubled(size: int, whole: dict[int, Column]) -> Column:
        if lengths and 2 * size <= max(lengths):
            pairs = _pair(whole[size], whole[size], size)
            return let(pairs, lambda g: doubled(2 * size, {**whole, 2 * size: g}))
        return summed(0, whole, {})

    def summed(k: int, whole: dict[int, Column], grams: dict[int, Column]) -> Column:
        if k == len(lengths):
            return body(grams)
        n = lengths[k]
        parts = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
        return joined(whole[parts[0]], parts[0], parts[1:], k, whole, grams)

    def joined(current, done, parts, k, whole, grams) -> Column:
        if parts:
            pairs = _pair(current, whole[parts[0]], done)
            return let(pairs, lambda g: joined(g, done + parts[0], parts[1:], k, whole, grams))
        n = lengths[k]
        cut = F.slice(current, F.lit(1), F.greatest(F.size(hashes) - F.lit(n - 1), F.lit(0)))
        return let(cut, lambda g: summed(k + 1, whole, {**grams, n: g}))

    return doubled(1, {1: hashes})


def _pair(left: Column, right: Column, shift: int) -> Column:
    return F.transform(left, lambda x, i: F.xxhash64(x, F.get(right, i + F.lit(shift))))


def scan_windows(words: Column, lengths: list[int]) -> Column:
    """{words, grams}: all windows {len, pos, hash} of the lengths, after a marker of length 0.

    The marker keeps a text in a join with known windows, which then holds one row of length 0 too.
    """
    marker = F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("hash"))

    def placed(n: int, hashes: Column) -> Column:
        def place(h, i):
            return F.struct(F.lit(n).alias("len"), i.alias("pos"), h.alias("hash"))

        return F.transform(hashes, place)

    def all_windows(grams: dict[int, Column]) -> Column:
        every = F.concat(F.array(marker), *[placed(n, h) for n, h in grams.items()])
        return F.struct(words.alias("words"), every.alias("grams"))

    return let(hash_words(words), lambda h: gram_hashes(h, lengths, all_windows))


#: Values folded in one go by running(); keeps the work on very long arrays far below quadratic.
_BLOCK = 256


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals (from 0) of an array of longs, itself bound by ``let``; ``merge`` is associative."""

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), merge)

    def with_blocks(blocks: Column) -> Column:
        return let(
            F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))),
            lambda bases: F.transform(
                values,
                lambda _, i: merge(
                    F.get(bases, (i / _BLOCK).cast("int")),
                    total(F.slice(values, i - i % _BLOCK + 1, i % _BLOCK + 1)),
                ),
            ),
        )

    numbers = F.sequence(F.lit(0), ((F.size(values) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: total(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(values) > 0, let(blocks, with_blocks)).otherwise(empty)


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of longs, itself bound by ``let``."""
    return running(values, lambda a, b: a + b)


def text_key(doc_id: Column, text: Column) -> Column:
    """What stands for a row in joins: 128 bits, equal for repeated rows, never NULL."""
    id_ = doc_id.cast("string")
    # the length in front tells where an id ends
    known = F.concat(F.length(id_).cast("string"), F.lit(":"), id_)
    mark = F.when(text.isNull(), "n").otherwise("t")
    return F.unhex(F.md5(F.concat(F.coalesce(known, F.lit("-")), mark, F.coalesce(text, F.lit("")))))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
