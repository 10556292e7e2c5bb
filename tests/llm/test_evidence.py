"""What the language stage rejects, and what the bootstrapping of personal data reaches."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from rolelens.llm import pii


def test_language_stage_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    unlearned = ["Ελληνικά κείμενα δεν έχει μάθει κανείς εδώ σήμερα", "日本語の文章はここでは学習されていません",
                 "Этот язык здесь никто не учил и никогда не будет", "qJ8xZk0vWq7YtRzXgHjKqWvBzNxQpLkZxVbQwZxJ" * 5]
    clean = ["the house and the garden", "der Mann und die Frau", "that is not from here", "das ist nicht ein Wort"]
    rows = [(1_000_000 + i, t, "en") for i, t in enumerate(unlearned)]
    rows += [(2_000_000 + i, t, None) for i, t in enumerate(clean)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, both, brute.SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in both.where("doc_id < 1000000 OR doc_id >= 2000000").select("doc_id").collect()}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = pii.find(docs).select("_key", F.explode("extra").alias("s"))
    keyed = docs.select(pii.text_key(F.col("doc_id"), F.col("text")).alias("_key"), "text")
    rows = values.join(keyed, "_key").collect()
    return {(r.text[r.s.start : r.s.end], pii.KINDS[r.s.kind_no]) for r in rows}


def in_context(word, tokens):
    return [f"{word} {word}key {t} {word}end" for t in tokens]


def test_a_kind_that_is_most_of_the_corpus(spark):
    mails = [f"u{i}@mail.example.org" for i in range(400)]
    telling, idle = [f"K{i}" for i in range(5)], [f"Q{i}" for i in range(95)]
    texts = in_context("owner", mails[:200] + telling) + in_context("common", mails[200:] + idle[:50]) + in_context("pine", idle[50:])
    assert found(spark, texts) == {(t, "email") for t in telling}


def test_four_generations(spark):
    generations = [[f"u{i}@mail.example.org" for i in range(512)]]
    generations += [[f"K{g}-{i}" for i in range(n)] for g, n in ((1, 128), (2, 48), (3, 16), (4, 3))]
    texts = in_context("pine", [f"Q{i}" for i in range(3000)])
    for word, old, new in zip(["amber", "birch", "cedar", "dune"], generations, generations[1:], strict=False):
        texts += in_context(word, old + new)
    assert found(spark, texts) == {(t, "email") for own in generations[1:] for t in own}
