"""Ranked lexical search over a prefix tree of documents, by branch and bound.

Documents are first reduced to vectors over the terms of the searched items: which of these terms they
hold and how often. Each task builds trees of a bounded number of its own documents: a vector's terms are
ordered from the most to the least frequent one in the corpus, so documents with common terms share a path
from the root, and the rare terms lie far down. Every subtree knows the greatest count of each of its terms
and the smallest length measure ``m`` of its documents. A term's part of the score grows with its count and
shrinks with m, so both give an upper bound for the subtree, per item. The search goes down depth first,
best child first, and leaves out subtrees whose bound is below the item's k-th best score so far.

Items are taken in blocks whose texts have a bounded size, one pass over the documents for each block;
a block's terms and vectors are broadcast. Bounds start from the k-th best scores within a fixed share of the
documents; every document is searched, and a task reports at most k documents per item.

Defined results: a NULL or empty text has no terms, is in no ranking and does not count. Items without
known terms get no rows. Repeated documents are ranked one by one, missing ids after all others. Items with
equal id and text are searched once; other texts with the same id get a ranking each. A single item longer
than a block is a block of its own. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolelens.llm import arrays
from rolelens.session import ensure_checkpoint_dir

TOP = 20
#: Texts of the items of one block, in bytes; about what is broadcast.
BLOCK_BYTES = 4 << 20
#: Documents and vector entries of one tree.
TREE_ROWS = 8192
TREE_ENTRIES = 1 << 20
#: Documents of one leaf.
LEAF_ROWS = 32
#: One in so many documents gives the first bounds.
SEEDS = 16

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: all but ASCII digits, letters and other characters separates; A-Z lower-cased."""
    return _TERM.findall(text.lower())  # of bytes, ASCII alone is lower-cased


def length_measure(n: int, documents: int, total: int) -> int:
    return 75 + 25 * n * documents // total


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def part(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score, before its weight; grows with the count, shrinks with m."""
    return 1_000_000_000 * count // (1000 * count + 12 * m)


# --- vectors ------------------------------------------------------------------------------------


def vectors(documents: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts: length in terms, and number and count of each known term, by number."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in arrays.pieces(batches):
            lengths, own, counts = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                found = terms(text or b"")
                kept = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
                lengths.append(len(found))
                own.append([t for t, _ in kept])
                counts.append([c for _, c in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(own, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    schema = f"doc_id {id_type}, n long, terms array<int>, counts array<long>"
    return documents.select("doc_id", "text").mapInArrow(rows, schema).where("n > 0")


# --- trees --------------------------------------------------------------------------------------


@dataclass
class Node:
    """A subtree. Its children's bounds lie one after the other, so that one pass rates them all.

    An inner node has ``children``, and ``terms`` and ``parts`` of child i from ``starts[i]`` on. A leaf has
    ``documents`` instead, whose own parts are kept in the same form.
    """

    children: list[Node]
    documents: list[list]  # ids of equal documents, smallest first
    terms: np.ndarray
    parts: np.ndarray
    starts: np.ndarray

    def rated(self, wanted: np.ndarray) -> np.ndarray:
        """Per child or document, the bound or score for an item with these weights."""
        if not len(self.terms):
            return np.zeros(len(self.starts), np.int64)
        sums = np.append(0, np.cumsum(wanted[self.terms] * self.parts))
        return sums[np.append(self.starts[1:], len(self.terms))] - sums[self.starts]


def _id_order(doc_id) -> tuple:
    return (doc_id is None, doc_id)


class Tree:
    """A tree over documents. Document i has id and m at i and its terms from ``ptr[i]`` to ``ptr[i + 1]``:
    their ranks by falling frequency (sorted), their numbers and their counts."""

    def __init__(
        self, ids: list, m: np.ndarray, ptr: np.ndarray, ranks: np.ndarray, names: np.ndarray,
        counts: np.ndarray, k: int = TOP,
    ):
        big_endian = ranks.astype(">u4").tobytes()  # orders like the vectors themselves
        spans = list(zip((4 * ptr[:-1]).tolist(), (4 * ptr[1:]).tolist(), strict=True))
        rows = [(big_endian[a:b], counts[a // 4 : b // 4].tobytes(), int(x)) for (a, b), x in zip(spans, m, strict=True)]
        alike: dict[tuple, list[int]] = {}
        for row, key in enumerate(rows):
            alike.setdefault(key, []).append(row)
        self.keys = sorted(alike)
        first = np.array([alike[key][0] for key in self.keys], np.int64)
        # of equal documents only the first k can be in a ranking
        self.ids = [heapq.nsmallest(k, (ids[r] for r in alike[key]), key=_id_order) for key in self.keys]
        size = (ptr[1:] - ptr[:-1])[first]
        self.ptr = np.append(0, np.cumsum(size))
        at = np.arange(self.ptr[-1]) + np.repeat(ptr[:-1][first] - self.ptr[:-1], size)
        self.ranks, self.names, self.counts = ranks[at], names[at], counts[at]
        self.m = m[first]
        self.root = self._built(0, len(first))

    def _depth(self, lo: int, hi: int) -> int:
        """Terms that all documents of the range share from the root on."""
        a = self.ranks[self.ptr[lo] : self.ptr[lo + 1]]
        b = self.ranks[self.ptr[hi - 1] : self.ptr[hi]]
        size = min(len(a), len(b))
        differs = a[:size] != b[:size]
        return int(differs.argmax()) if differs.any() else size

    def _branches(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges below a node: one per next term; neighbours that fit into one leaf stay together."""
        depth = self._depth(lo, hi)
        ends = self.ptr[lo + 1 : hi + 1] - self.ptr[lo:hi] == depth
        place = np.minimum(self.ptr[lo:hi] + depth, len(self.ranks) - 1)
        following = np.where(ends, -1, self.ranks[place] if len(self.ranks) else -1)
        cuts = [lo, *(lo + 1 + np.flatnonzero(following[1:] != following[:-1])).tolist(), hi]
        if len(cuts) == 2:  # equal vectors of other lengths or counts
            return [(a, min(a + LEAF_ROWS, hi)) for a in range(lo, hi, LEAF_ROWS)]
        ranges = [(cuts[0], cuts[1])]
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            if b - ranges[-1][0] <= LEAF_ROWS:
                ranges[-1] = (ranges[-1][0], b)
            else:
                ranges.append((a, b))
        return ranges

    def _built(self, lo: int, hi: int) -> Node:
        """The subtree over a range of documents, made from the leaves up."""
        made: dict[tuple[int, int], tuple] = {}
        stack = [(lo, hi, None)]  # no recursion, as paths can be as long as vectors
        while stack:
            a, b, below = stack.pop()
            if below is not None:
                made[a, b] = self._joined([made.pop(r) for r in below])
            elif b - a <= LEAF_ROWS:
                made[a, b] = self._leaf(a, b)
            else:
                below = self._branches(a, b)
                stack.append((a, b, below))
                stack.extend((*r, None) for r in below)
        return made[lo, hi][0]

    def _leaf(self, lo: int, hi: int) -> tuple[Node, np.ndarray, np.ndarray, int]:
        """A node, its distinct terms, their greatest counts, and the smallest m."""
        span = slice(self.ptr[lo], self.ptr[hi])
        size = self.ptr[lo + 1 : hi + 1] - self.ptr[lo:hi]
        own = part(self.counts[span], np.repeat(self.m[lo:hi], size))
        node = Node([], self.ids[lo:hi], self.names[span], own, self.ptr[lo:hi] - self.ptr[lo])
        return node, *_greatest(self.names[span], self.counts[span]), int(self.m[lo:hi].min())

    def _joined(self, below: list[tuple]) -> tuple:
        names = np.concatenate([b[1] for b in below])
        counts = np.concatenate([b[2] for b in below])
        size = np.array([len(b[1]) for b in below])
        lowest = np.array([b[3] for b in below])
        bounds = part(counts, np.repeat(lowest, size))
        node = Node([b[0] for b in below], [], names, bounds, np.cumsum(size) - size)
        return node, *_greatest(names, counts), int(lowest.min())


def _greatest(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms and the greatest count of each."""
    if not len(names):
        return names, counts
    order = np.argsort(names, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(names[order]) != 0))
    return names[order][starts], np.maximum.reduceat(counts[order], starts)


def search(root: Node, wanted: np.ndarray, best: list[tuple], floor: int, k: int) -> None:
    """Add a tree's documents to ``best``: at most k of (score, falling order of ids, id), as a heap.

    ``wanted`` has the item's weight per term; documents below ``floor`` are of no use.
    """
    stack = [(0, root)]
    while stack:
        bound, node = stack.pop()
        if bound and bound < (best[0][0] if len(best) == k else floor):
            continue
        rated = node.rated(wanted)
        least = best[0][0] if len(best) == k else floor
        hopeful = np.flatnonzero(rated >= least)
        if node.children:
            order = hopeful[np.argsort(rated[hopeful], kind="stable")]  # the best child comes off the stack first
            stack.extend((int(rated[i]), node.children[i]) for i in order.tolist())
            continue
        for i in hopeful.tolist():
            for doc_id in node.documents[i]:
                entry = (int(rated[i]), _Falling(doc_id))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif best[0] < entry:
                    heapq.heapreplace(best, entry)


class _Falling:
    """An id whose order is turned round: of equal scores, greater ids leave a ranking first."""

    __slots__ = ("id",)

    def __init__(self, doc_id):
        self.id = doc_id

    def __eq__(self, other):
        return self.id == other.id

    def __lt__(self, other):
        return _id_order(other.id) < _id_order(self.id)


# --- ranking ------------------------------------------------------------------------------------


@dataclass
class Block:
    """What tasks need to know of a block of items: all of it has at most about BLOCK_BYTES of text."""

    items: list[list[tuple[int, int]]]  # per item (number of the term, occurrences times weight)
    rank: np.ndarray  # per term its place by falling frequency
    documents: int
    total: int


def _found(rows: DataFrame, block: Block, floors: list[int], k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: what the tasks' searches find."""
    shared = rows.sparkSession.sparkContext.broadcast((block, floors))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = shared.value
        best: list[list[tuple]] = [[] for _ in block.items]
        wanted = np.zeros(len(block.rank), np.int64)
        kind = None
        for group in _groups(batches):
            kind = group.schema.field("doc_id").type
            tree = _tree(group, block, k)
            for own, kept, floor in zip(block.items, best, floors, strict=True):
                numbers = [t for t, _ in own]
                wanted[numbers] = [w for _, w in own]
                search(tree.root, wanted, kept, floor, k)
                wanted[numbers] = 0
        out = [(i, e[1].id, e[0]) for i, kept in enumerate(best) for e in kept]
        if out:
            items, ids, scores = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return rows.mapInArrow(ranked, f"item int, doc_id {id_type}, score long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, as many as one tree takes."""
    held, rows, entries = [], 0, 0
    for batch in arrays.pieces(batches):
        held.append(batch)
        rows += batch.num_rows
        entries += len(batch.column(2).flatten())
        if rows >= TREE_ROWS or entries >= TREE_ENTRIES:
            yield pa.Table.from_batches(held)
            held, rows, entries = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _tree(group: pa.Table, block: Block, k: int) -> Forest:
    ids, n, own, counts = (c.combine_chunks() for c in group.columns)
    ptr = np.append(0, np.cumsum(np.asarray(own.value_lengths()))).astype(np.int64)
    names = np.asarray(own.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), np.diff(ptr))
    ranks = block.rank[names]
    order = np.lexsort((ranks, row))
    # python's numbers, so that the product cannot overflow
    m = np.array([length_measure(x, block.documents, block.total) for x in n.to_pylist()], np.int64)
    return Tree(ids.to_pylist(), m, ptr, ranks[order], names[order], np.asarray(counts.flatten())[order], k)


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _block_ranking(documents: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """item, doc_id, score, rank for the (item_id, text) pairs; None when no document has a term of theirs."""
    own = [Counter(terms((text or "").encode())) for _, text in items]
    known = {w: i for i, w in enumerate(sorted(set().union(*own)))}
    if not known:
        return None
    reduced = vectors(documents, known).checkpoint()
    size = reduced.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = reduced.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per term
    df = np.zeros(len(known), np.int64)
    for r in held:
        df[r["term"]] = r["count"]
    if not held:
        return None
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(known))
    weights = [weight(int(f), size.documents) for f in df]
    wanted = [[(known[w], c * weights[known[w]]) for w, c in one.items()] for one in own]
    block = Block(wanted, rank, size.documents, size.total)
    seeds = reduced.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDS)) == 0)
    lowest = _top(_found(seeds, block, [1] * len(items), k), k).where(F.col("rank") == k).collect()
    floors = [1] * len(items)
    for r in lowest:  # at most one row per item of the block
        floors[r["item"]] = max(1, r["score"])
    return _top(_found(reduced, block, floors, k), k)


def ranking(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Per item its k documents of the highest score: item_id, rank, doc_id, score.

    ``documents`` has doc_id and text, ``items`` item_id and text.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    asked = items.select("item_id", "text").distinct().checkpoint()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    id_type = asked.schema["item_id"].dataType.simpleString()
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id {doc_type}, score long")
    for b in range(blocks):
        block = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        found = _block_ranking(documents, block, k) if block else None
        if found is not None:
            names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {id_type}")
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
