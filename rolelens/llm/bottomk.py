"""Near-duplicates by bottom-k sketches.

A document's set holds the hashes of its word shingles; its sketch the ``SKETCH`` smallest of them. Two
documents of the similarity asked for share at least ``shared()`` sketch values (the smallest values of
the union are a sample of it; missing that many has a chance of a few in a million), so of the values of
a sketch, ordered from rare to frequent, only the first SKETCH - shared() + 1 need an inverted list, and
frequent passages have lists only of documents that consist of little else.

Documents with equal sets are one class from the start. A class is set aside as soon as too few of its
values occur anywhere else, first by its sketch, then, for those left, by its whole set. Of its
inverted lists every class takes the most central class (whose values the most others hold) and is
compared with that one, which joins a large group of copies in as many comparisons as it has members.
Two classes of one centre that are not both linked to it can only be linked if they differ from it in
the same values, so pairs within a group come from inverted lists of those differences, again from rare
to frequent; pairs across groups come from the first lists. Pairs are made only between classes that
are still apart and whose counts allow the similarity; that is decided for whole cells of equal counts
before any pair is made. Union sketches estimate the similarity of a pair, exact Jaccard of the whole
sets confirms it, and links make components.

Whole sets are only read, in a second pass, for classes that may have a link; a Bloom filter of bounded
size passes those.

Defined results: a text that is NULL or without words has an empty set and is linked with nothing. Rows
with equal texts are one class, also with equal ids. A component is named by its smallest id; in a
component without any id, the rows with the smallest text key are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.llm import arrays
from rolelens.llm.components import components
from rolelens.llm.text import fresh, text_key
from rolelens.session import ensure_checkpoint_dir

WORDS = 5
SKETCH = 64
#: A link: 100 * intersection >= percent * union. This is the similarity of the query's contract.
PERCENT = 85
#: The largest chance that the sketches of a link share too few values.
_MISSED = 2.5e-6
#: 64-bit words of the Bloom filter for the second pass.
BLOOM_WORDS = 1 << 18
_BLOOM_HASHES = 3


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of each text, as signed 64-bit hashes."""
    for block in arrays.word_blocks(texts, arrays.BLANK):
        hashes, counts = arrays.shingles(block, words)
        hashes = hashes.view(np.int64)
        ends = np.cumsum(counts)
        for start, end in zip(ends - counts, ends, strict=True):
            yield np.unique(hashes[start:end])


def _set_hash(values: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(values, digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


#: Texts that are handled in one go.
_ROWS = 1024


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def sketches(documents: DataFrame, size: int = SKETCH) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text_key, n_shingles, set_hash, sketch (sorted)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            sets = list(shingle_sets(piece.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_hash(s) for s in sets], pa.binary()),
                    _lists([s[:size] for s in sets]),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_hash", "sketch"],
            )

    keyed = documents.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text")
    return keyed.mapInArrow(rows, "doc_id long, text_key binary, n_shingles long, set_hash binary, sketch array<long>")


def _bloom_positions(keys: pa.Array) -> list[np.ndarray]:
    """For each hash the bits of text keys, by their first half."""
    half = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2]
    bits = np.uint64(BLOOM_WORDS * 64)
    return [arrays.mix(half + np.uint64(k)) % bits for k in range(_BLOOM_HASHES)]


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of text keys: BLOOM_WORDS words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bloom_positions(batch.column(0)))
            mask = np.left_shift(np.uint64(1), at % np.uint64(64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(mask)], names=["word", "mask"]
            )

    words = keys.mapInArrow(rows, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = words.toArrow()  # at most BLOOM_WORDS rows
    out = np.zeros(BLOOM_WORDS, np.uint64)
    out[table["word"].to_numpy()] = table["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def whole_sets(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """set_key, n, values (the sorted set) of ``classes`` (set_key, text_key of one of its texts)."""
    filter_ = documents.sparkSession.sparkContext.broadcast(_bloom(classes.select("text_key")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            passed = np.ones(piece.num_rows, bool)
            for at in _bloom_positions(piece.column(0)):
                passed &= (filter_.value[at // np.uint64(64)] >> at % np.uint64(64) & np.uint64(1)).astype(bool)
            some = piece.filter(pa.array(passed))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), _lists(list(shingle_sets(some.column(1))))], names=["text_key", "values"]
            )

    keyed = documents.select(text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text")
    read = keyed.mapInArrow(rows, "text_key binary, values array<long>").dropDuplicates(["text_key"])
    return read.join(classes.select("set_key", "text_key"), "text_key").select(
        "set_key", F.size("values").cast("long").alias("n"), "values"
    )


def shared(percent: int = PERCENT) -> int:
    """Sketch values that a link shares, but for a chance of ``_MISSED``: 40 of 64 at 85 %, 35 at 80 %."""
    p, fewer, least = percent / 100, 0.0, 0
    while least < SKETCH:
        fewer += math.comb(SKETCH, least) * p**least * (1 - p) ** (SKETCH - least)
        if fewer > _MISSED:
            break
        least += 1
    return least


def _needed(n: Column, percent: int) -> Column:
    """Sketch values that a link to a set of size n is sure to share."""
    return F.least(F.lit(shared(percent)), F.ceil(n * percent / 100))


def _apart(percent: int) -> float:
    """Two sets are linked if they differ in at most this share of their sizes' sum."""
    return (100 - percent) / (100 + percent)


#: Keeps rounding from cutting a bound that is met exactly.
_SLACK = 1e-6


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets of two groups, with counts of own and shared values, can reach the similarity.

    Their difference is at least own_x + own_y + |shared_x - shared_y|.
    """
    own_x, own_y, shared_x, shared_y = (F.col(f"{s}.{c}") for c in ("own", "shared") for s in (x, y))
    apart = own_x + own_y + F.abs(shared_x - shared_y)
    sizes = own_x + own_y + shared_x + shared_y
    other_group = F.col(f"{x}.centre") != F.col(f"{y}.centre")
    return other_group & (apart * (100 + percent) <= sizes * (100 - percent))


def _may_link_in_group(x: str, y: str, percent: int) -> Column:
    """Whether sets of one centre, with d differences from it of which s are shared, can be linked.

    They differ in d_x + d_y values less twice the common ones, of which there are at most min(s_x, s_y).
    """
    d, n = F.col(f"{x}.d") + F.col(f"{y}.d"), F.col(f"{x}.n") + F.col(f"{y}.n")
    common = F.least(F.col(f"{x}.s"), F.col(f"{y}.s"))
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (
        ~(F.col(f"{x}.linked") & F.col(f"{y}.linked"))
        & (d - 2 * common <= n * _apart(percent) + _SLACK)
        & (large * percent <= small * 100)
    )


def _open_pairs(
    members: DataFrame, lists: list[str], counts: list[str], feasible: Callable[[str, str], Column]
) -> DataFrame:
    """Pairs (a, b) of a list whose counts are ``feasible`` and whose roots differ.

    ``members`` has the list's columns, the counts, set_key and root. Cells of equal counts are paired
    first, so a list costs as many comparisons as it has pairs of cells, and only open cells are spelt out.
    """
    cells = members.groupBy(*lists, *counts).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    cells = cells.checkpoint()

    def struct(side: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in counts])

    def same(left: str, right: str, columns: dict[str, str]) -> Column:
        pairs = [F.col(f"{left}.{m}") == F.col(f"{right}.{n}") for m, n in columns.items()]
        return reduce(lambda p, q: p & q, pairs)

    one_root = (
        (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    )
    together = same("x", "y", {c: c for c in lists}) & (struct("x") <= struct("y"))
    open_cells = cells.alias("x").join(cells.alias("y"), together & ~one_root & feasible("x", "y"))
    open_cells = open_cells.select(
        *[F.col(f"x.{c}").alias(c) for c in lists],
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("x", "y") for c in counts],
        (struct("x") == struct("y")).alias("one_cell"),
    )

    def spelt(frame: DataFrame, side: str, more: Column) -> DataFrame:
        own = members.select(
            *[F.col(c).alias(f"{c}_own") for c in (*lists, *counts)],
            F.col("set_key").alias(f"key_{side}"), F.col("root").alias(f"root_{side}"),
        )
        columns = {c: f"{c}_own" for c in lists} | {f"{c}_{side}": f"{c}_own" for c in counts}
        met = frame.alias("f").join(own.alias("m"), same("f", "m", columns) & more)
        return met.drop(*[f"{c}_own" for c in (*lists, *counts)])

    apart = (F.col("root_x") != F.col("root_y")) & (~F.col("one_cell") | (F.col("key_x") < F.col("key_y")))
    pairs = spelt(spelt(open_cells, "x", F.lit(True)), "y", apart)
    return pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def _inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """value, set_key: the lists that can bring linked classes together; ``classes`` has set_key, n, sketch."""
    postings = classes.select("set_key", F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").checkpoint()
    known = postings.join(common, "value").groupBy("set_key").agg(F.collect_list(F.struct("df", "value")).alias("known"))
    posted = known.join(classes.select("set_key", "n"), "set_key").select(
        "set_key",
        # values of its own come first in the order and need no list
        F.slice(F.sort_array("known"), F.lit(1), F.greatest(F.size("known") - _needed(F.col("n"), percent).cast("int") + 1, F.lit(0))).alias("first"),
    )
    return posted.select("set_key", F.explode("first.value").alias("value"))


def _own_counts(sets: DataFrame, percent: int) -> DataFrame:
    """set_key, n, own (values in no other of these sets), shared, weight, of the classes that can have a link.

    ``weight`` is how many of these sets hold one of its values, on average.
    """
    values = sets.select("set_key", F.explode("values").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").checkpoint()
    shared = values.join(common, "value").groupBy("set_key").agg(F.count("*").alias("shared"), F.sum("df").alias("df"))
    counted = sets.select("set_key", "n").join(shared, "set_key")
    return counted.where(F.col("shared") * 100 >= F.col("n") * percent).select(
        "set_key", "n", (F.col("n") - F.col("shared")).alias("own"), "shared", (F.col("df") / F.col("n")).alias("weight")
    )


def _group_lists(homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """centre, value, set_key, n, d, s, linked: inverted lists of differences from the centre.

    ``homes`` has set_key, centre and linked. Groups that are linked to their centre as a whole need none,
    nor do groups of one besides the centre, which can be in a group of its own or of a heavier centre.
    """
    others = F.count(F.when(F.col("set_key") != F.col("centre"), 1)).alias("others")
    open_ = homes.groupBy("centre").agg(others, F.min("linked").alias("settled"))
    open_ = open_.where("others >= 2 AND NOT settled").select("centre")
    own = sets.select("set_key", "n", F.col("values").alias("vx"))
    middle = sets.select(F.col("set_key").alias("centre"), F.col("values").alias("vp"))
    differing = F.concat(F.array_except("vx", "vp"), F.array_except("vp", "vx"))
    differences = (
        homes.join(open_, "centre")
        .join(own, "set_key")
        .join(middle, "centre")
        .select("centre", "set_key", "n", "linked", differing.alias("values"))
        .select("centre", "set_key", "n", "linked", F.size("values").alias("d"), F.explode("values").alias("value"))
        .checkpoint()
    )
    common = differences.groupBy("centre", "value").agg(F.count("*").alias("df")).where("df > 1").checkpoint()
    known = (
        differences.join(common, ["centre", "value"])
        .groupBy("centre", "set_key", "n", "linked", "d")
        .agg(F.collect_list(F.struct("df", "value")).alias("known"))
        .withColumn("s", F.size("known"))
    )
    # common differences that a link needs at least, given the sizes that a partner can have; at
    # least one, as a partner of a linked set is itself not linked to the centre
    largest = F.col("n") * (_apart(percent) * (1 + 100 / percent))
    least = F.when(F.col("linked"), F.col("d") * ((1 - _apart(percent)) / 2)).otherwise(F.col("d") - largest)
    needed = F.greatest(F.ceil(least - _SLACK).cast("int"), F.lit(1))
    first = F.slice(F.sort_array("known"), F.lit(1), F.greatest(F.col("s") - needed + 1, F.lit(0)))
    posted = known.where(F.col("s") >= needed).select("centre", "set_key", "n", "linked", "d", "s", first.alias("first"))
    return posted.select("centre", "set_key", "n", "linked", "d", "s", F.explode("first.value").alias("value"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) of set keys that are links."""

    def with_values(frame: DataFrame, values: Column) -> DataFrame:
        for side in ("a", "b"):
            own = sets.select(F.col("set_key").alias(side), values.alias(f"v{side}"))
            frame = frame.join(own, side)
        return frame

    guess = with_values(pairs, F.slice("values", 1, SKETCH))
    union = F.slice(F.array_sort(F.array_union("va", "vb")), 1, SKETCH)
    both = F.array_intersect(union, F.array_intersect("va", "vb"))
    likely = guess.where(F.size(both) * SKETCH >= F.size(union) * shared(percent)).select("a", "b")
    whole = with_values(likely, F.col("values")).withColumn("both", F.size(F.array_intersect("va", "vb")))
    union_size = F.size("va") + F.size("vb") - F.col("both")
    return whole.where(F.col("both") * 100 >= union_size * percent).select("a", "b")


def class_links(documents: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that suffice for their components.

    ``classes`` has set_key, text_key (of one of its texts in ``documents``), n and sketch.
    """
    lists = _inverted_lists(classes, percent).checkpoint()
    candidates = lists.select("set_key").distinct().join(classes.select("set_key", "text_key"), "set_key").checkpoint()
    sets = whole_sets(documents, candidates).checkpoint()
    counts = _own_counts(sets, percent).checkpoint()
    members = lists.join(counts, "set_key").checkpoint()

    # each class with the most central one of its lists
    centre = members.groupBy("value").agg(F.max(F.struct("weight", "set_key")).alias("centre"))
    homes = (
        members.select("value", "set_key")
        .join(centre, "value")
        .groupBy("set_key")
        .agg(F.max("centre")["set_key"].alias("centre"))
        .checkpoint()
    )
    a, b = F.least("set_key", "centre").alias("a"), F.greatest("set_key", "centre").alias("b")
    star = _confirmed(homes.where("set_key <> centre").select(a, b).distinct(), sets, percent).checkpoint()
    roots = components(star).withColumnRenamed("node", "set_key").checkpoint()
    homes = (
        homes.select("set_key", "centre", a, b)
        .join(star.withColumn("yes", F.lit(True)), ["a", "b"], "left")
        .select("set_key", "centre", (F.col("yes").isNotNull() | (F.col("set_key") == F.col("centre"))).alias("linked"))
        .checkpoint()
    )

    def placed(frame: DataFrame) -> DataFrame:
        return frame.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")).checkpoint()

    across = placed(members.select("value", "set_key", "own", "shared").join(homes.select("set_key", "centre"), "set_key"))
    within = placed(_group_lists(homes, sets, percent))
    across_groups, in_group = partial(_may_link, percent=percent), partial(_may_link_in_group, percent=percent)
    apart = (
        _open_pairs(across, ["value"], ["own", "shared", "centre"], across_groups)
        .unionByName(_open_pairs(within, ["centre", "value"], ["n", "d", "s", "linked"], in_group))
        .distinct()
    )
    return star.unionByName(_confirmed(apart, sets, percent))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text_key, n_shingles, component_id, kept.

    Links are pairs of a similarity of at least ``percent`` hundredths.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    rows = sketches(documents).checkpoint()
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("set_hash")
        .agg(
            F.min("doc_id").alias("smallest"), F.min("text_key").alias("text_key"),
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        )
        # a class has a number of its own; it is fixed once the classes are stored
        .withColumn("set_key", F.monotonically_increasing_id())
        .checkpoint()
    )
    grouped = components(class_links(documents, classes, percent)).withColumnRenamed("node", "set_key").checkpoint()
    named = (
        grouped.join(classes.select("set_key", "smallest", "text_key"), "set_key")
        .groupBy("root")
        .agg(F.min("smallest").alias("linked"), F.min("text_key").alias("first"))
    )
    linked = grouped.join(named, "root").select("set_key", "linked", "first")
    ids = (
        classes.select("set_key", "set_hash", "smallest", "text_key")
        .join(linked, "set_key", "left")
        .select(
            "set_hash", F.when(F.col("first").isNull(), F.col("smallest")).otherwise(F.col("linked")).alias("component_id"),
            F.coalesce("first", "text_key").alias("first_key"),
        )
        .checkpoint()
    )
    own = rows.select("doc_id", "text_key", "n_shingles", "set_hash")
    full = own.where("n_shingles > 0").join(ids, "set_hash")
    empty = own.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "first_key": F.col("text_key")})
    without_id = F.col("doc_id").isNull() & F.col("component_id").isNull() & (F.col("text_key") == F.col("first_key"))
    return full.unionByName(empty).select(
        "doc_id", "text_key", "n_shingles", "component_id",
        (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) | without_id).alias("kept"),
    )


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns kept; rows without words all stay."""
    found = near_duplicates(documents, percent).checkpoint()
    name = fresh(documents, "kept_key")
    same = text_key(F.col("doc_id"), F.col("text")) == F.col(name)
    dropped = found.where(~F.col("kept")).select(F.col("text_key").alias(name)).distinct()
    rest = documents.join(dropped, same, "left_anti")
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy(F.col("text_key").alias(name)).count()
    again = again.where("count > 1").select(name)
    if again.isEmpty():
        return rest
    once = rest.join(again, same, "left_anti")
    return once.unionByName(rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
