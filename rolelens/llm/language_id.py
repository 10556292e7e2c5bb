"""Language identification by n-gram membership in bit-sliced Bloom filters.

One filter serves all languages: each of its slots holds a mask with one bit per language, in as many
64-bit words as there are languages, and the AND of an n-gram's slots gives all languages that contain it. A document's n-grams are looked up at once,
the bits counted per language, and the shares corrected for the filter's false positives, which follow
from how full each language's slice is. The largest corrected share decides.

Training counts, over all learnable documents, in how many documents of each language an n-gram occurs;
partial counts are made per batch before the shuffle. An n-gram belongs to a language if its rate there
is at least ``MIN_RATE`` and not far below its best rate. A language has at most (n-grams per document /
MIN_RATE) such n-grams however large the corpus is, and the collected filter has at least ``SLOTS`` rows, or
``ROOM`` for each n-gram of the language with most of them, so that no slice is more than a quarter full.

N-grams are four bytes of the lower-cased text with all but letters blanked.

Defined results: a text that is NULL or has no letter is ``und`` with score 0. A text with letters but
no known n-gram gets the most frequent language, with score 0; ties go to the first name. Rows without
language or text are not learned from; without any such row every text is ``und``. Repeated rows count
as often as they occur. ``keep_identified`` can also ask for a score, and ``score_floor`` takes one from
the held-out rows; a text of few n-grams may fall short of it by what chance explains. If nothing was
learned, it keeps every text with a letter.
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

GRAM = 4
SLOTS = 1 << 18
ROOM = 8
HASHES = 2
MIN_RATE = 0.005
#: An n-gram's rate in a language against its best rate in any.
NEAR_BEST = 0.3
UNDETERMINED = "und"
#: A text has a learned language if it scores this share of what NEARLY_ALL held-out rows reach.
FLOOR_SHARE = 0.5
NEARLY_ALL = 0.99
#: A score of n n-grams may lie this over the root of n below the floor: two standard deviations at most.
WIDENING = 1.0
_STEPS = 1000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    languages: list[str]  # most frequent first
    filter: np.ndarray  # per slot a mask of languages, in words of 64

    def false_positives(self) -> np.ndarray:
        """Per language, the chance that an n-gram it does not have passes all its slots."""
        full = [np.mean(_bit(self.filter, i)) for i in range(len(self.languages))]
        return np.array(full, float) ** HASHES


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return masks[:, language // 64] >> np.uint64(language % 64) & np.uint64(1)


def slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    return [
        (arrays.mix(grams.astype(np.uint64) + np.uint64(k << 40)) % np.uint64(size)).astype(np.int64)
        for k in range(HASHES)
    ]


def gram_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (number of the first text, n-grams of all its texts, n-grams per text)."""
    data, offsets = arrays.utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    for first, last in arrays.blocks(offsets):
        # a blank before and after each text, so that its ends count as word ends
        own = offsets[first : last + 1] - offsets[first]
        n = last - first
        part = data[offsets[first] : offsets[last]]
        padded = np.full(len(part) + GRAM * (n + 1), 0x20, np.uint8)
        shift = np.repeat(np.arange(1, n + 1) * GRAM, np.diff(own))
        padded[np.arange(len(part)) + shift] = np.where(_LETTERS[part], part, 0x20)
        count = len(padded) - GRAM + 1
        codes = np.zeros(count, np.uint32)
        for k in range(GRAM):
            codes |= padded[k : k + count].astype(np.uint32) << np.uint32(8 * k)
        keep = np.flatnonzero(padded[1 : 1 + count] != 0x20)
        ends = own[1:] + np.arange(1, n + 1) * GRAM
        yield first, codes[keep], np.diff(np.searchsorted(keep, np.append(0, ends)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text) rows: in how many texts of a language each n-gram occurs, summed over some blocks."""
    seen: dict[str, list[np.ndarray]] = {}
    held = 0
    for batch in arrays.pieces(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, grams, counts in gram_blocks(batch.column(1)):
            texts = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
            pairs = np.unique(texts << np.uint64(32) | grams)
            owners, codes = (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)
            own = langs[first : first + len(counts)][owners]
            for lang in set(langs[first : first + len(counts)]):
                seen.setdefault(lang, []).append(codes[own == lang])
            held += len(codes)
            if held > HELD:
                yield from _summed(seen)
                seen, held = {}, 0
    yield from _summed(seen)


#: N-grams that a task holds before it sums them up.
HELD = 4_000_000


def _summed(seen: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in seen.items():
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)],
            names=["lang", "gram", "n"],
        )


def train(documents: DataFrame) -> Model:
    """Learns from the rows of ``documents`` (lang, text) that have both."""
    rows = documents.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row per language
    languages = [r["lang"] for r in sizes]
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Model([], np.zeros((SLOTS, words), np.uint64))
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    bits = np.left_shift(np.uint64(1), np.arange(len(languages), dtype=np.uint64) % np.uint64(64)).view(np.int64).tolist()
    known = spark.createDataFrame(
        [(lang, r["count"], i // 64, bits[i]) for i, (lang, r) in enumerate(zip(languages, sizes, strict=True))],
        "lang string, texts long, word int, bit long",
    )
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rates = counted.join(known, "lang").withColumn("rate", F.col("n") / F.col("texts"))
    often = rates.where(F.col("rate") >= MIN_RATE)
    best = often.groupBy("gram").agg(F.collect_list(F.struct("rate", "word", "bit")).alias("rates"))  # one per language
    top = F.array_max(F.transform("rates", lambda r: r["rate"]))
    kept = best.select("gram", F.explode(F.filter("rates", lambda r: r["rate"] >= NEAR_BEST * top)).alias("r"))
    kept = kept.select("gram", "r.word", "r.bit").checkpoint()
    most = kept.groupBy("word", "bit").count().agg(F.max("count")).first()[0] or 0
    size = max(SLOTS, 1 << (ROOM * most - 1).bit_length()) if most else SLOTS
    slotted = kept.mapInArrow(_to_slots(size), "slot long, word int, mask long").groupBy("slot", "word").agg(
        F.bit_or("mask").alias("mask")
    )
    table = slotted.toArrow()  # at most as many rows as slots, for each 64 languages
    filled = np.zeros((size, words), np.uint64)
    filled[table["slot"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Model(languages, filled)


def _to_slots(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slots(batch.column(0).to_numpy(), size):
                yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns[1:]], names=["slot", "word", "mask"])

    return rows


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text."""
    return _predicted(texts, model)[:2]


def _predicted(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, the score and the number of n-grams of each text."""
    n, k = len(texts), len(model.languages)
    sizes = np.zeros(n, np.int64)
    shares = np.zeros((n, max(k, 1)))
    if k:
        wrong = model.false_positives()
        for first, grams, counts in gram_blocks(texts):
            full = np.flatnonzero(counts)
            sizes[first : first + len(counts)] = counts
            if not len(full):
                continue
            masks = np.bitwise_and.reduce([model.filter[s] for s in slots(grams, len(model.filter))])
            starts = (np.cumsum(counts) - counts)[full]
            for i in range(k):
                bits = _bit(masks, i).astype(np.uint8)
                hits = np.add.reduceat(bits, starts, dtype=np.int64) / counts[full]
                shares[first + full, i] = np.clip((hits - wrong[i]) / max(1e-9, 1 - wrong[i]), 0, 1)
    lettered = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    known = lettered & bool(k)
    best = shares.argmax(axis=1)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
    return names, np.where(known, shares.max(axis=1), 0.0), sizes


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.filter))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            names, score = predict(batch.column(1), Model(*shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: Model, floor: float = 0.0) -> DataFrame:
    """The rows of ``documents``, all columns kept, whose language could be determined with a score of ``floor``.

    The floor is lower for texts of few n-grams. Without any learned language only texts without a letter go.
    """
    if not model.languages:
        return documents.where(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.filter))
    at = documents.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            names, score, sizes = _predicted(batch.column(at), Model(*shared.value))
            lettered = np.array([name != UNDETERMINED for name in names], bool)
            enough = score >= floor - WIDENING / np.sqrt(np.maximum(sizes, 1))
            yield batch.filter(pa.array(lettered & enough))

    return documents.mapInArrow(rows, documents.schema)


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_floor(documents: DataFrame, model: Model) -> float:
    """A score that texts in a learned language reach: ``FLOOR_SHARE`` of what nearly all held-out rows do.

    Of the held-out rows of ``documents`` (doc_id, text, lang) those count whose language is predicted right.
    Without any, every score above 0 will do.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.filter))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            names, score = predict(batch.column(1), Model(*shared.value))
            right = np.array([a == b for a, b in zip(names, batch.column(0).to_pylist(), strict=True)], bool)
            steps, n = np.unique((score[right] * _STEPS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(n.astype(np.int64))], names=["step", "n"])

    held = documents.select("lang", "text", "doc_id").where(held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = held.select("lang", "text").mapInArrow(rows, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    table = sorted((r["step"], r["n"]) for r in counts.collect())  # at most _STEPS + 1 rows
    below, total = 0, sum(n for _, n in table)
    for step, n in table:
        below += n
        if below > (1 - NEARLY_ALL) * total:
            return max(FLOOR_SHARE * step / _STEPS, 1 / _STEPS)
    return 1 / _STEPS


def learned(documents: DataFrame) -> Model:
    """A model of all documents (doc_id, text, lang) that are not held out."""
    return train(documents.where(~held_out(F.col("doc_id"))))


def languages(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    return identify(documents, learned(documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
