"""Near-duplicates of families that drift apart, against brute force."""

import collections
import itertools
import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from rolelens.llm import bottomk
from rolelens.llm.text import text_key


def families(n, seed=11):
    """Texts of ``n`` families of their own words: copies of a text, and others that drift away from it by edits."""
    rnd = random.Random(seed)
    out = []
    for f in range(n):
        vocabulary = [f"f{f}w{i}" for i in range(2000)]

        def edited(text, edits, vocabulary=vocabulary):
            text = list(text)
            for at in rnd.sample(range(len(text)), edits):
                text[at] = rnd.choice(vocabulary)
            return text

        base = rnd.choices(vocabulary, k=rnd.randrange(60, 130))
        drift = [base]
        for _ in range(8):
            drift.append(edited(rnd.choice(drift[-2:]), rnd.randrange(1, 3)))
        out += drift + [edited(base, rnd.randrange(1, 3)) for _ in range(rnd.randrange(4, 12))]
    return [(i, " ".join(text)) for i, text in enumerate(out)]


def test_drifting_families(spark):
    rows = families(150)
    want = brute.near_components(rows)
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")
    wrong = {r.doc_id: (r.component_id, want[r.doc_id][1]) for r in got.collect() if r.component_id != want[r.doc_id][1]}
    assert not wrong, len(wrong)
    assert 150 < len({c for _, c in want.values()}) < len(rows) - 150


def smallest_ids(rows, percent):
    """The ids that stay: the smallest of each component of pairs of that similarity; ids without words too."""
    sets = [(i, brute.shingles(t)) for i, t in sorted(rows)]
    holders, root = collections.defaultdict(list), {i: i for i, _ in sets}
    for i, own in sets:
        for x in own:
            holders[x].append(i)
    size, common = {i: len(own) for i, own in sets}, collections.Counter()
    for own in holders.values():
        common.update(itertools.combinations(own, 2))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (size[a] + size[b] - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i for i in root if find(i) == i}


def test_stage_drops_copies_of_similarity_80(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text")
    rows = [(1_000_000 + i, t) for i, t in families(25, seed=5)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    rows += [(r.doc_id, r.text) for r in docs.where("doc_id < 1000000").collect()]
    got = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, brute.SF).select("doc_id").collect()]
    want = smallest_ids(rows, 80)
    assert len(got) == len(want) and set(got) == want
    assert len(want) < len(smallest_ids(rows, 85))


def test_values_that_a_link_shares():
    assert (bottomk.shared(85), bottomk.shared(80)) == (40, 35)


def test_half_a_key_decides_nothing(spark, monkeypatch):
    """Sets and rows whose 64 leading bits are all the same stay apart."""
    whole_set, whole_row = bottomk._set_hash, bottomk.text_key
    monkeypatch.setattr(bottomk, "_set_hash", lambda values: b"samehalf" + whole_set(values)[8:])
    monkeypatch.setattr(
        bottomk, "text_key", lambda i, t: F.concat(F.lit(b"samehalf"), F.substring(whole_row(i, t), 9, 8))
    )
    rows = families(12, seed=2)
    want = brute.near_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bottomk.near_duplicates(docs).collect()
    assert {bytes(r.text_key)[:8] for r in got} == {b"samehalf"}
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    kept = bottomk.keep_one(docs).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {c for _, c in want.values()}


def test_row_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, ""), (1, None), (None, "1:1ta"), (None, ""), (None, None), (11, "a"), (1, "1a"), (1, "ta")]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select(text_key(F.col("doc_id"), F.col("text")).alias("k"))
    keys = [bytes(r.k) for r in keyed.collect()]
    assert {len(k) for k in keys} == {16} and len(set(keys)) == len(rows) - 1
    texts = spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("a:", "b")], "doc_id string, text string")
    assert texts.select(text_key(F.col("doc_id"), F.col("text")).alias("k")).distinct().count() == 5
