"""Toxicity: a linear classifier that is penalised for reacting to who is mentioned.

For every training text with identity terms, each term is swapped for the next of its group, and the
squared change of the score's logit joins the loss. Weights that only tell groups apart go to zero, so a
neutral mention of a group does not raise a score.

Features are counts (log1p) of words and of word beginnings, which carry over to unseen endings. The fit
uses a bounded sample of labelled rows: the ``TRAINING_ROWS`` smallest by a hash of their id, so the
table sent to the executors and what the driver holds (their counts of at most ``FEATURES`` selected
features) are bounded by these parameters. All texts are scored, in one pass without a shuffle.

Defined results: a NULL or empty text has no words and the score of the bias alone. A row without label
or id is not learned from; an id with several labels counts as toxic if any is. Without both labels the
score is the smoothed share of label 1. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.llm import arrays
from rolelens.session import ensure_checkpoint_dir

TRAINING_ROWS = 20_000
FEATURES = 2048
MIN_TEXTS = 3
#: Bytes of a word's beginning.
PREFIXES = (4, 6)
L2 = 1e-4
SWAP_PENALTY = 10.0
STEPS = 400

# Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # one per feature
    length_weight: float  # of log1p(words), about usual_length
    bias: float
    usual_length: float = 0.0


def _salt(kind: int) -> np.uint64:
    return arrays.mix(np.array([kind + 1], np.uint64))[0]


def feature_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first text, text number of each feature, features, words per text)."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    kinds = [arrays.word_blocks(lowered, arrays.NOT_ALNUM, p) for p in (None, *PREFIXES)]
    for parts in zip(*kinds, strict=True):
        owner = np.repeat(np.arange(len(parts[0].counts)), parts[0].counts)
        features = np.concatenate([part.hashes ^ _salt(k) for k, part in enumerate(parts)])
        yield parts[0].first, np.tile(owner, len(parts)), features, parts[0].counts


def _counted(owner: np.ndarray, features: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the vocabulary, count) of the features that are in the sorted vocabulary."""
    if not len(vocabulary) or not len(features):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    place = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
    known = vocabulary[place] == features
    pairs, count = np.unique(owner[known] * len(vocabulary) + place[known], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), count


def _word_features(words: list[str]) -> list[np.ndarray]:
    """The features of single words."""
    return [next(feature_blocks(pa.array([word])))[2] for word in words]


def swaps(groups=IDENTITY_TERMS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Identity words (sorted hashes of whole words), and the features each loses and gains by its swap."""
    terms = [(t, group[(i + 1) % len(group)]) for group in groups for i, t in enumerate(group)]
    lost, gained = _word_features([t for t, _ in terms]), _word_features([t for _, t in terms])
    whole = np.array([f[0] for f in lost], np.uint64)
    order = np.argsort(whole)
    return whole[order], [lost[i] for i in order], [gained[i] for i in order]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, text) rows, per block: feature, texts of label 1 and of label 0 that have it."""
    for batch in batches:
        label = batch.column(0).to_numpy()
        for first, owner, features, counts in feature_blocks(batch.column(1)):
            order = np.lexsort((owner, features))
            f, o = features[order], owner[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
            f, toxic = f[new], label[first : first + len(counts)][o[new]]
            names, start = np.unique(f, return_index=True)
            if not len(names):
                continue
            one = np.add.reduceat(toxic.astype(np.int64), start)
            every = np.diff(np.append(start, len(f)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(one), pa.array(every - one)], names=["feature", "one", "zero"]
            )


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, one for each id: doc_id, label, text. They are stored.

    Of several texts with one id the one with the smallest hash counts, found map-side.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    labelled = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "label", "text").checkpoint()


def select_features(sample: DataFrame, features: int = FEATURES) -> np.ndarray:
    """The features whose share among the texts of label 1 differs most clearly from the others', sorted."""
    counted = (
        sample.select(F.col("label").cast("long"), "text")
        .mapInArrow(_document_counts, "feature long, one long, zero long")
        .groupBy("feature")
        .agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
        .where(F.col("one") + F.col("zero") >= MIN_TEXTS)
    )
    totals = sample.agg(F.sum("label").alias("one"), F.count("*").alias("n")).first()
    n1, n0 = max(1, totals["one"] or 0), max(1, totals["n"] - (totals["one"] or 0))
    odds = F.log((F.col("one") + 0.5) / (n1 - F.col("one") + 0.5)) - F.log((F.col("zero") + 0.5) / (n0 - F.col("zero") + 0.5))
    spread = F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    best = counted.orderBy(F.desc(F.abs(odds / spread)), "feature").limit(features).select("feature").collect()
    return np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))


def _rows(vocabulary: np.ndarray, groups):
    """A function for mapInArrow: per (label, text) row its counts, and the change a swap of terms makes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _, _ = swaps(groups)
        for batch in batches:
            for first, owner, features, counts in feature_blocks(batch.column(1)):
                n = len(counts)
                text, place, count = _counted(owner, features, vocabulary)
                edges = np.searchsorted(text, np.arange(n + 1))
                own = np.searchsorted(terms, features)
                found = terms[np.minimum(own, len(terms) - 1)] == features if len(terms) else np.zeros(len(features), bool)
                changes: dict[int, list[int]] = {}
                for t, term in zip(owner[found], own[found], strict=True):
                    changes.setdefault(int(t), []).append(int(term))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(counts, pa.int64()),
                        pa.array([place[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.list_(pa.int64())),
                        pa.array([count[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.list_(pa.int64())),
                        pa.array([changes.get(i, []) for i in range(n)], pa.list_(pa.int64())),
                    ],
                    names=["label", "words", "place", "count", "swapped"],
                )

    return rows


def fit(sample: DataFrame, features: int = FEATURES, swap_penalty: float = SWAP_PENALTY, groups=IDENTITY_TERMS) -> Model:
    """A model of the sample (label, text)."""
    chosen = select_features(sample, features)
    terms, lost, gained = swaps(groups)
    # features of identity words are always in, so that their weights can be held down
    vocabulary = np.unique(np.concatenate([chosen, *lost, *gained])) if len(terms) else chosen
    table = (
        sample.select(F.col("label").cast("long"), "text")
        .mapInArrow(
            _rows(vocabulary, groups),
            "label long, words long, place array<long>, count array<long>, swapped array<long>",
        )
        .toArrow()
    )
    y = table["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(vocabulary, np.zeros(len(vocabulary)), 0.0, float(np.log(share / (1 - share))))
    sizes = np.array([len(p) for p in table["place"].to_pylist()])
    row = np.repeat(np.arange(len(y)), sizes)
    column = table["place"].combine_chunks().flatten().to_numpy().astype(np.int64)
    count = table["count"].combine_chunks().flatten().to_numpy().astype(float)
    value = np.log1p(count)
    length = np.log1p(table["words"].to_numpy())
    d_row, d_column, d_value = _changes(row, column, count, table["swapped"].to_pylist(), vocabulary, lost, gained)
    weights, length_weight, bias = _descend(
        y, row, column, value, length, d_row, d_column, d_value, len(vocabulary), swap_penalty
    )
    return Model(vocabulary, weights, length_weight, bias, float(length.mean()))


def _changes(row, column, count, swapped, vocabulary, lost, gained):
    """The swapped texts' features minus their own: (pair, column, difference of log1p counts)."""
    start = np.searchsorted(row, np.arange(len(swapped) + 1))
    pairs, columns, values = [], [], []
    for number, (text, terms) in enumerate((i, t) for i, t in enumerate(swapped) if t):
        own = dict(zip(column[start[text] : start[text + 1]], count[start[text] : start[text + 1]], strict=True))
        new = dict(own)
        for term in terms:
            for sign, features in ((-1, lost[term]), (1, gained[term])):
                for c in np.searchsorted(vocabulary, features):
                    new[c] = new.get(c, 0.0) + sign
        for c, v in new.items():
            change = np.log1p(max(v, 0.0)) - np.log1p(own.get(c, 0.0))
            if change:
                pairs.append(number)
                columns.append(c)
                values.append(change)
    return np.array(pairs, np.int64), np.array(columns, np.int64), np.array(values)


def _descend(y, row, column, value, length, d_row, d_column, d_value, size, swap_penalty):
    """Logistic loss, ridge and swap penalty by Adam, over the whole sample in each step."""
    n, pairs = len(y), (int(d_row.max()) + 1 if len(d_row) else 0)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(size + 2)  # features, length, bias
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    length = length - length.mean()
    for step in range(1, STEPS + 1):
        logit = np.bincount(row, w[column] * value, n) + w[-2] * length + w[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * balance / n
        slope = np.empty_like(w)
        slope[:size] = np.bincount(column, error[row] * value, size) + L2 * w[:size]
        slope[-2], slope[-1] = error @ length + L2 * w[-2], error.sum()
        if pairs:
            change = np.bincount(d_row, w[d_column] * d_value, pairs)
            slope[:size] += np.bincount(d_column, 2 * swap_penalty / pairs * change[d_row] * d_value, size)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:size], float(w[-2]), float(w[-1])


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 for each text."""
    logit = np.full(len(texts), model.bias)
    for first, owner, features, counts in feature_blocks(texts):
        n = len(counts)
        text, place, count = _counted(owner, features, model.features)
        own = np.bincount(text, model.weights[place] * np.log1p(count), n)
        logit[first : first + n] += own + model.length_weight * (np.log1p(counts) - model.usual_length)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, score, predicted."""
    parts = (model.features, model.weights, model.length_weight, model.bias, model.usual_length)
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column(1).fill_null(""), Model(*shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. ``labels`` has doc_id and toxic."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    model = fit(training_sample(documents, known))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
