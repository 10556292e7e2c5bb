"""Benchmark decontamination: a broadcast set of benchmark n-grams, scanned by token windows.

A window is ``size`` consecutive words; an item with fewer words, but not none, is one window of its
own length. Every window of every document is looked up by hash in the set, each hit is verified on
its words, and the hit positions are merged per document. Only hits and one marker row per document
are shuffled, never texts or windows. A benchmark whose windows take more than ``BROADCAST_BYTES`` is joined by
shuffle instead: positions and hashes of all windows go to the windows of the benchmark, and the hits back to
their documents, whose words travel once.

Defined results: a NULL or empty text has no words and is clean. Repeated documents are judged one by
one. A repeated item counts once; an item without id makes words hit but is not listed. With an empty
benchmark all documents are clean. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.llm.text import fresh, gram_hashes, hash_words, let, scan_windows, text_key, word_array
from rolelens.session import ensure_checkpoint_dir

WINDOW = 10

#: Between a word and the separators after it.
WORD_END = r"(?<=[^\x00-\x2F\x3A-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x60\x7B-\x7F])"

#: Windows that take up to this many bytes, items and hashes included, are sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes of a window beside its words and items.
_WINDOW_BYTES = 64


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window: win_words, win_len, win_hash, win_items (sorted item ids as strings)."""
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = words.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("win_words")
    )
    grouped = windows.groupBy("win_words").agg(F.sort_array(F.collect_set("item_id")).alias("win_items"))
    return grouped.withColumn("win_len", F.size("win_words"))


def _with_hash(windows: DataFrame, lengths: list[int]) -> DataFrame:
    def own(grams):
        return F.coalesce(F.lit(None).cast("long"), *[F.get(F.when(F.col("win_len") == n, grams[n]), F.lit(0)) for n in lengths])

    hashed = let(hash_words(F.col("win_words")), lambda h: gram_hashes(h, lengths, own))
    return windows.select("win_words", "win_items", "win_len", hashed.alias("win_hash"))


def _hits(documents: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Rows of hit windows (win_len > 0), and one row per document with win_len 0."""
    ensure_checkpoint_dir(documents.sparkSession)
    windows = benchmark_windows(benchmark, size).checkpoint()
    texts = F.octet_length(F.array_join("win_words", " ")) + F.octet_length(F.array_join("win_items", " "))
    # at most ``size`` rows
    known = windows.groupBy("win_len").agg(F.sum(texts + _WINDOW_BYTES).alias("bytes")).collect()
    lengths = sorted(r["win_len"] for r in known)
    if sum(r["bytes"] for r in known) > BROADCAST_BYTES:
        return _shuffled_hits(documents, _with_hash(windows, lengths), lengths)
    docs = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        text_key(F.col("doc_id"), F.col("text")).alias("_key"),
        "doc_id",
        let(word_array(F.col("text")), lambda words: scan_windows(words, lengths)).alias("scan"),
    )
    rows = docs.select(
        "_row", "_key", "doc_id", F.size("scan.words").cast("long").alias("n_words"),
        F.col("scan.words").alias("words"), F.explode("scan.grams").alias("g"),
    )
    spark = documents.sparkSession
    marker_row = spark.range(1).select(
        F.array().cast("array<string>").alias("win_words"), F.lit(None).cast("array<string>").alias("win_items"),
        F.lit(0).alias("win_len"), F.lit(0).cast("long").alias("win_hash"),
    )
    known_set = F.broadcast(_with_hash(windows, lengths).unionByName(marker_row))
    same_words = F.slice(F.col("words"), F.col("g.pos") + 1, F.col("win_len")) == F.col("win_words")
    return rows.join(
        known_set,
        (F.col("g.hash") == F.col("win_hash"))
        & (F.col("g.len") == F.col("win_len"))
        & ((F.col("win_len") == 0) | same_words),
    ).select("_row", "_key", "doc_id", "n_words", "win_len", F.col("g.pos").alias("pos"), "win_items")


def _shuffled_hits(documents: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``_hits`` for windows of any number; what is shuffled grows with the texts, not with their squares."""
    docs = documents.select(
        F.monotonically_increasing_id().alias("_row"), text_key(F.col("doc_id"), F.col("text")).alias("_key"), "doc_id", "text"
    ).checkpoint()  # so that a row keeps its number
    grams = let(word_array(F.col("text")), lambda words: scan_windows(words, lengths))["grams"]
    places = docs.select("_row", F.explode(grams).alias("g")).where("g.len > 0").select("_row", "g.pos", "g.len", "g.hash")
    maybe = places.join(windows, (F.col("hash") == F.col("win_hash")) & (F.col("len") == F.col("win_len")))
    found = maybe.groupBy("_row").agg(F.collect_list(F.struct("pos", "win_len", "win_words", "win_items")).alias("found"))
    none = F.array(F.struct(F.lit(0).alias("win_len"), F.lit(-1).alias("pos"), F.lit(None).cast("array<string>").alias("win_items")))

    def sure(words: Column) -> Column:
        same = F.filter("found", lambda f: F.slice(words, f["pos"] + 1, f["win_len"]) == f["win_words"])
        hits = F.transform(same, lambda f: F.struct(f["win_len"].alias("win_len"), f["pos"].alias("pos"), f["win_items"].alias("win_items")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(none, F.coalesce(hits, F.slice(none, 1, 0))).alias("hits"))

    judged = docs.join(found, "_row", "left").select(
        "_row", "_key", "doc_id", let(word_array(F.col("text")), sure).alias("sure")
    )
    rows = judged.select("_row", "_key", "doc_id", F.col("sure.n_words").alias("n_words"), F.explode("sure.hits").alias("h"))
    return rows.select("_row", "_key", "doc_id", "n_words", "h.win_len", "h.pos", "h.win_items")


def _covered(spans: Column) -> Column:
    """Words inside the union of spans {pos, win_len}, sorted by position."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def add(state, span):
        end = span["pos"] + span["win_len"]
        new = F.greatest(end - F.greatest(span["pos"], state["end"]), F.lit(0)).cast("long")
        return F.struct((state["total"] + new).alias("total"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(F.sort_array(spans), start, add, lambda state: state["total"])


def judge(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, spans, n_hit, items (sorted as strings), _key.

    ``spans`` lists the hit windows as {pos, win_len}, by word position from 0.
    """
    hit = F.col("win_len") > 0
    per_document = (
        _hits(documents, benchmark, size)
        .groupBy("_row", "_key", "doc_id", "n_words")
        .agg(
            F.sort_array(F.collect_set(F.when(hit, F.struct("pos", "win_len")))).alias("spans"),
            F.collect_set(F.when(hit, F.col("win_items"))).alias("sets"),
        )
    )
    return per_document.select(
        "_key", "doc_id", "n_words", "spans",
        _covered(F.col("spans")).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judge(documents, benchmark, size).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns kept. Repeated rows share one decision."""
    bad_key = fresh(documents, "bad_key")
    bad = judge(documents, benchmark, size).where("n_hit > 0").select(F.col("_key").alias(bad_key)).distinct()
    return documents.join(bad, text_key(F.col("doc_id"), F.col("text")) == F.col(bad_key), "left_anti")


def cut_spans(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All documents, with the hit words and the separators before them cut out of their texts.

    A text is split behind each word, so that piece i holds word i and the separators before it.
    """
    bad_key, spans = fresh(documents, "bad_key"), fresh(documents, "bad_spans")
    bad = (
        judge(documents, benchmark, size)
        .where("n_hit > 0")
        .groupBy(F.col("_key").alias(bad_key))
        .agg(F.first("spans").alias(spans))
    )
    text = F.col("text")
    parts = F.split(text, WORD_END)
    kept = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p"))),
        lambda x: ~F.exists(spans, lambda s: (x["i"] >= s["pos"]) & (x["i"] < s["pos"] + s["win_len"])),
    )
    cut = F.array_join(F.transform(kept, lambda x: x["p"]), "")
    columns = [F.when(F.col(spans).isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(c)
               for c in documents.columns]
    key = text_key(F.col("doc_id"), text)
    return documents.join(bad, key == F.col(bad_key), "left").select(*columns)

