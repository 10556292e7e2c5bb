"""Language identification and toxicity: held-out accuracy and defined results."""

import collections
import os

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolelens.llm import language_id, toxicity

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_language_of_held_out_documents(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = language_id.languages(documents).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark, documents, odd, odd_rows, nameless):
    model = language_id.learned(documents)
    assert model.languages[0] == "en" and max(model.false_positives()) < 0.05
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    for i, text in odd_rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), i
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in got.values())
    assert language_id.identify(nameless, model).count() == 7


def test_language_filters_hold_every_learned_gram(documents):
    """Bloom filters have no false negatives: a learned n-gram's mask has its language."""
    model = language_id.learned(documents.where("lang = 'de' OR lang = 'en'"))
    assert sorted(model.languages) == ["de", "en"]
    names, score = language_id.predict(pa.array(["der und die nicht ist ein", "the and that with from of"]), model)
    assert names == ["de", "en"] and score.min() > 0.3


def test_language_without_training(nothing, nameless):
    model = language_id.train(nothing)
    assert [r.lang_pred for r in language_id.identify(nameless, model).collect()] == ["und"] * 7
    assert language_id.languages(nothing).count() == 0


def grams_of(text):
    """Four bytes of the lower-cased text, all but letters blanked; not those that begin with two blanks' second."""
    data = "".join(c if c.isalpha() and (ord(c) > 127 or "a" <= c <= "z") or ord(c) > 127 else " " for c in text.lower())
    data = b" " * 4 + data.encode() + b" " * 4
    return [data[i : i + 4] for i in range(len(data) - 3) if data[i + 1] != 0x20]


def test_language_against_exact_sets(spark):
    """The filter answers like sets of n-grams do, but for its false positives."""
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    seen, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if brute.crc(i) % 4 != 2:
            seen[lang].update(set(grams_of(text)))
            texts[lang] += 1
    rates = {lang: {g: n / texts[lang] for g, n in own.items() if n / texts[lang] >= 0.005} for lang, own in seen.items()}
    best = collections.defaultdict(float)
    for own in rates.values():
        for g, r in own.items():
            best[g] = max(best[g], r)
    sets = {lang: {g for g, r in own.items() if r >= 0.3 * best[g]} for lang, own in rates.items()}
    order = sorted(texts, key=lambda x: (-texts[x], x))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in language_id.languages(docs).collect():
        own = grams_of(dict((i, t) for i, t, _ in rows)[r.doc_id])
        share = {lang: sum(g in sets[lang] for g in own) / max(1, len(own)) for lang in order}
        top = max(order, key=lambda x: share[x])
        assert abs(r.score - share[top]) < 0.03, r
        assert r.lang_pred == top or share[top] - share[r.lang_pred] < 0.05


def seventy(spark):
    letters = "abcdefghij"
    rows = []
    for k in range(70):
        stem = letters[k // 10] + letters[k % 10]
        rows += [(100 * k + i, " ".join(f"{stem}x{stem}{c}" for c in "klmno"), f"lang{k}") for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_seventy_languages(spark):
    docs = seventy(spark)
    model = language_id.learned(docs)
    assert len(model.languages) == 70 and model.filter.shape[1] == 2
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.languages(docs).collect()
    assert all(r.lang_pred == truth[r.doc_id] for r in rows) and len(rows) == 560


def test_filter_grows_with_the_ngrams(spark, documents, monkeypatch):
    monkeypatch.setattr(language_id, "SLOTS", 64)
    model = language_id.learned(documents)
    assert len(model.filter) > 64 and max(model.false_positives()) < 0.1


def test_unlabelled_documents_stay(spark, documents):
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    model = language_id.learned(none)
    odd = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    kept = language_id.keep_identified(odd, model, language_id.score_floor(none, model))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_short_texts_of_known_words_stay(spark, documents):
    model = language_id.learned(documents)
    floor = language_id.score_floor(documents, model)
    words = sorted({w for r in documents.limit(60).collect() for w in r.text.split() if any(c.isalpha() for c in w)})[:900]
    strange = ["\u0436\u0449\u044b\u0444 \u0446\u0449\u0443\u043a " * 8, "qzxv wqkx zzqj xkqz " * 12]
    rows = [(i, w) for i, w in enumerate(words)] + [(10_000 + i, w) for i, w in enumerate(strange)]
    kept = {r.doc_id for r in language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model, floor).collect()}
    assert len(kept) >= 0.998 * len(words) and not any(i >= 10_000 for i in kept)


def test_sample_is_bounded_in_rows(spark):
    docs = spark.range(300).selectExpr("id % 3 AS doc_id", "concat('text number ', id % 7) AS text")
    labels = spark.range(3).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS label")
    assert toxicity.training_sample(docs, labels, rows=2).count() == 2
    assert toxicity.training_sample(docs, labels).count() == 3
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def read(_):
        seen.add(1)
        return True

    toxicity.toxicity(docs.where(read.asNondeterministic()("text")), labels.withColumnRenamed("label", "toxic")).collect()
    assert seen.value <= 2 * 300


def test_toxicity_of_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(documents, labels).collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9
    assert sum((s >= 0.5) == y for s, y in held) >= 0.9 * len(held)


def biased_sample(spark):
    """Insults are toxic; one group is mentioned mostly in toxic texts."""
    rows = []
    for i in range(200):
        toxic = i % 2
        group = "muslims" if toxic and i % 10 else ("christians", "muslims", "jews")[i % 3]
        rows.append((i, int(toxic), f"text {i} about {group} who are {'awful trash' if toxic else 'our friends'} here"))
        rows.append((1000 + i, 0, f"neutral words number {i % 7} and more"))
    return spark.createDataFrame(rows, "doc_id long, label int, text string")


def test_swap_penalty_removes_group_bias(spark):
    sample = biased_sample(spark).cache()
    neutral = pa.array(["about muslims who came here", "about christians who came here"])
    free = toxicity.scores(neutral, toxicity.fit(sample, swap_penalty=0.0))
    held = toxicity.scores(neutral, toxicity.fit(sample))
    assert free[0] - free[1] > 0.05 and abs(held[0] - held[1]) < 0.2 * (free[0] - free[1])
    assert toxicity.scores(pa.array(["muslims are awful trash"]), toxicity.fit(sample))[0] > 0.5


def test_toxicity_of_odd_texts(spark, odd, odd_rows, nameless, nothing):
    labels = spark.createDataFrame(
        [(100_008, 1), (100_008, 0), (None, 1), (5, None), (100_009, 0), (100_006, 1)], "doc_id long, toxic int"
    )
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in toxicity.toxicity(nameless, none).collect()} == {0.5}
    assert toxicity.toxicity(nothing, none).count() == 0
