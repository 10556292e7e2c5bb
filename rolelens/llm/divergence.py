"""Quality rules by the divergence of a document's histograms from those of its language.

Two histograms are compared with the ones of all documents of the same ``lang`` by the Jensen-Shannon
distance (the root of the divergence in bits, 0 to 1): classes of characters, and the common words of the
language with all others as one bin. Text in capitals, strewn with symbols, or made of lists and repeated
words lies far from its language in one or the other. Histograms of short texts scatter: the limits
widen with one over the root of the length, and below a minimum length a histogram does not judge.

Common words are those that make up at least ``MIN_SHARE`` of a language's words, so there are at most
1 / MIN_SHARE of them. They are found exactly in two passes over the texts. First each task counts all words
of its rows with bounded memory (whenever too many are held, rare ones go, which loses at most a known
share of its words) and reports those that may matter; from the sums follow all candidates. Then the
candidates alone are counted. No word but these leaves a task. A third pass judges the documents.

References are collected for ``LANGUAGES`` languages at a time, and each document is judged with its own
language's block, so what is broadcast is bounded whatever ``lang`` holds.

Defined results: NULL and empty texts have no words and fail the base rules. Documents without ``lang``
are a language of their own. In a language with fewer than ``MIN_REFERENCE`` words in all, and below the
minimum lengths, only the base rules judge. Repeated rows count and are judged one by one. Columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.llm import arrays, grams
from rolelens.session import ensure_checkpoint_dir

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

#: Share of a language's words from which on a word is common.
MIN_SHARE = 0.002
#: What a task may lose of a word, as a share of the language's words in the task.
_LOSS = MIN_SHARE / 4
#: Words that a task holds while counting.
HELD_WORDS = 200_000
MIN_REFERENCE = 20_000
LANGUAGES = 200

#: Limits of the distances, their widening, and the lengths from which on they hold.
CHAR_LIMIT, CHAR_WIDENING, CHAR_MINIMUM = 0.25, 1.0, 200  # characters
WORD_LIMIT, WORD_WIDENING, WORD_MINIMUM = 0.25, 2.0, 50  # words

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Classes of characters: a-z, A-Z, digits, blanks, common punctuation, other signs, controls, not ASCII.
CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[0x21:0x7F] = 5
for _i, _chars in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, *range(0x09, 0x0E)), b".,;:!?'\"()-")):
    _CLASS[list(_chars)] = _i
_CONTINUES = (np.arange(256) & 0xC0) == 0x80  # bytes that do not begin a character
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


# --- one text -------------------------------------------------------------------------------------


def classes(text: bytes) -> np.ndarray:
    """Characters per class."""
    data = np.frombuffer(text, np.uint8)
    return np.bincount(_CLASS[data[~_CONTINUES[data]]], minlength=CLASSES)


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


def repeated_words(codes: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text has more than once."""
    names = grams.gram_codes(codes, size)
    if not len(names):
        return 0
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    in_words = int(np.count_nonzero(~_CONTINUES[data] & ~arrays.BLANK[data]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeated_words(grams.word_codes(words))
    return len(words), in_words, int(np.count_nonzero(_SYMBOL[data])), len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram from the shares of a reference; 0 for an empty one."""
    total = counts.sum()
    if not total:
        return 0.0
    own = counts / total
    middle = (own + reference) / 2

    def to_middle(x: np.ndarray) -> float:
        some = x > 0
        return float(np.sum(x[some] * np.log2(x[some] / middle[some])))

    return max(0.0, (to_middle(own) + to_middle(reference)) / 2) ** 0.5


def word_counts(found: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """How often the text has each common word, and all others together."""
    counts = np.zeros(len(common) + 1, np.int64)
    for word, n in Counter(found).items():
        counts[common.get(word, len(common))] += n
    return counts


@dataclass
class Reference:
    """A language: shares of the classes, the common words, and their shares with that of all others."""

    classes: np.ndarray
    common: dict[bytes, int]
    words: np.ndarray


def judged(text: bytes, reference: Reference | None) -> tuple:
    """Base counts, base_failed, kept, and both distances (NULL where a histogram does not judge)."""
    base = base_counts(text)
    failed = base_failed(base[0], base[4])
    char_distance = word_distance = None
    if reference is not None:
        own, found = classes(text), terms(text)
        if own.sum() >= CHAR_MINIMUM:
            char_distance = distance(own, reference.classes)
        if len(found) >= WORD_MINIMUM:
            word_distance = distance(word_counts(found, reference.common), reference.words)
    far = (char_distance is not None and char_distance > CHAR_LIMIT + CHAR_WIDENING / own.sum() ** 0.5) or (
        word_distance is not None and word_distance > WORD_LIMIT + WORD_WIDENING / len(found) ** 0.5
    )
    return *base, failed, not failed and not far, char_distance, word_distance


# --- references -------------------------------------------------------------------------------


class _Held:
    """Counts of words by language, with bounded memory: a word loses at most _LOSS of its language's words."""

    def __init__(self):
        self.totals, self.lost = Counter(), Counter()
        self.counts: dict[str, Counter] = {}
        self.room = HELD_WORDS

    def add(self, lang: str, words: list[bytes]) -> None:
        self.totals[lang] += len(words)
        self.counts.setdefault(lang, Counter()).update(words)
        self.room -= len(words)
        if self.room < 0:
            for name, own in self.counts.items():
                # whoever was dropped before had at most ``lost``; so has whoever goes now
                least = int(_LOSS / 2 * self.totals[name])
                self.counts[name] = Counter({w: n for w, n in own.items() if n + self.lost[name] > least})
                self.lost[name] = max(self.lost[name], least)
            self.room = max(HELD_WORDS - sum(map(len, self.counts.values())), HELD_WORDS // 10)

    def reported(self) -> Iterator[tuple[str, bytes | None, int]]:
        """(language, None, all its words), and words with their counts that are not too rare to matter."""
        for lang, total in self.totals.items():
            yield lang, None, total
            for word, n in self.counts[lang].items():
                if n + self.lost[lang] > _LOSS * total:
                    yield lang, word, n + self.lost[lang]


def _lang(c: str = "lang") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of all rows."""
    for batch in arrays.pieces(batches):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield from zip(batch.column(0).to_pylist(), (t or b"" for t in texts), strict=True)


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    lang, key, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], names=["lang", "key", "n"]
    )


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def candidates(documents: DataFrame) -> DataFrame:
    """lang, key, n: per language all its words (key NULL), and upper bounds for words that may be common.

    ``documents`` has lang (not NULL) and text. Every common word of a language is among them, and at most
    2 / (MIN_SHARE - _LOSS) words; languages of fewer than MIN_REFERENCE words are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for lang, text in _texts(batches):
            held.add(lang, terms(text))
        found = list(held.reported())
        for at in range(0, len(found), 10_000):
            yield _counted(found[at : at + 10_000])

    sums = _summed(documents.select("lang", "text").mapInArrow(rows, "lang string, key binary, n long"))
    totals = sums.where(F.col("key").isNull() & (F.col("n") >= MIN_REFERENCE)).select("lang", F.col("n").alias("total"))
    joined = sums.join(totals, "lang")
    # a task that does not report a word has at most _LOSS of its words missing in the sum
    hopeful = F.col("key").isNull() | (F.col("n") >= (MIN_SHARE - _LOSS) * F.col("total"))
    return joined.where(hopeful).select("lang", "key", "n")


def references(documents: DataFrame, hopeful: dict[str, set[bytes]], totals: dict[str, int]) -> dict[str, Reference]:
    """References of the languages in ``hopeful``, counted exactly over all their documents."""
    shared = documents.sparkSession.sparkContext.broadcast(hopeful)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        for lang, text in _texts(batches):
            wanted = shared.value[lang]
            words.setdefault(lang, Counter()).update(w for w in terms(text) if w in wanted)
            chars[lang] = chars.get(lang, 0) + classes(text)
        out = [(lang, b"w" + w, n) for lang, own in words.items() for w, n in own.items()]
        out += [(lang, b"c%d" % i, n) for lang, own in chars.items() for i, n in enumerate(own.tolist())]
        if out:
            yield _counted(out)

    counted = _summed(documents.select("lang", "text").mapInArrow(rows, "lang string, key binary, n long"))
    chars = {lang: np.zeros(CLASSES) for lang in hopeful}
    common: dict[str, list[tuple[bytes, int]]] = {lang: [] for lang in hopeful}
    for r in counted.collect():  # the classes and candidates of at most LANGUAGES languages
        key = bytes(r["key"])
        if key[:1] == b"c":
            chars[r["lang"]][int(key[1:])] = r["n"]
        elif r["n"] >= MIN_SHARE * totals[r["lang"]]:
            common[r["lang"]].append((key[1:], r["n"]))
    out = {}
    for lang, words in common.items():
        words.sort()
        n = np.array([c for _, c in words], float)
        shares = np.append(n, totals[lang] - n.sum()) / totals[lang]
        out[lang] = Reference(chars[lang] / chars[lang].sum(), {w: i for i, (w, _) in enumerate(words)}, shares)
    return out


# --- documents --------------------------------------------------------------------------------

_COLUMNS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
    ("char_distance", "double"), ("word_distance", "double"),
)
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _judged(documents: DataFrame, known: dict[str, Reference]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(known)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches):
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            langs = batch.column(1).to_pylist()
            out = [judged(t or b"", shared.value.get(lang)) for t, lang in zip(texts, langs, strict=True)]
            made = [pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*out, strict=True), _COLUMNS, strict=True)]
            names = ["doc_id", *[n for n, _ in _COLUMNS]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    schema = ", ".join([f"doc_id {id_type}", *[f"{n} {k}" for n, k in _COLUMNS]])
    return documents.select("doc_id", "lang", "text").mapInArrow(rows, schema)


def quality(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, char_distance, word_distance.

    ``documents`` has doc_id, text and lang.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    docs = documents.select("doc_id", "text", _lang().alias("lang"))
    hopeful = candidates(docs).checkpoint()
    languages = hopeful.where("key IS NULL").count()
    blocks = -(-languages // LANGUAGES) or 1
    out = None
    for b in range(blocks):
        block = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b
        # on average LANGUAGES languages of at most 2 / (MIN_SHARE - _LOSS) words
        words: dict[str, set[bytes]] = {}
        totals: dict[str, int] = {}
        for r in hopeful.where(block).collect():
            own = words.setdefault(r["lang"], set())
            if r["key"] is None:
                totals[r["lang"]] = r["n"]
            else:
                own.add(bytes(r["key"]))
        mine = docs if blocks == 1 else docs.where(block)
        known = references(mine.where(F.col("lang").isin(list(words))), words, totals) if words else {}
        part = _judged(mine, known)
        out = part if out is None else out.unionByName(part)
    return out
