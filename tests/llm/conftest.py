import pytest
from brute import SF
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))
NOTICE = "Licensed under the Apache License, Version 2.0. All rights reserved. CC BY cc-by all Rights RESERVED"
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "!!! ... 12",
    "one",
    "ÉTÉ Straße ﬁn 日本語 \U0001f600 a",
    NOTICE,
    NOTICE,
    "Write to a.b+c@mail.example.com or x@y, call +1 (017) 555-7713 from 10.0.0.255 not 10.0.0.256, "
    "pay 4111 1111 1111 1111 or 4111111111111112",
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +12 3 ++4912345678901 0000255.01.1.1 5500-0000-0000-0004x",
    "9" * 5000 + " " + "a" * 5000 + "@",
    LONG,
    LONG + " one more",
]

#: Names that the operators use inside.
CLASHING = ["_row", "_key", "words", "n_words", "value", "score", "set_key", "spans", "part", "lang_pred", "_extra"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with ids from 100000 on and 200 documents; columns with clashing names."""
    rows = [(100_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs)
    return both.withColumns({c: F.lit("x") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nameless(spark):
    """Repeated rows, rows without id, without text and without both."""
    text = "the same text of more than five words in all of these rows"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, "plain words only"), (3, "plain words only")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
