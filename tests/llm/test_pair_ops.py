"""SimHash and near-duplicates against plain Python."""

import random

import brute
import pyarrow as pa

from rolelens.llm import bottomk, simhash
from rolelens.llm.components import components


def test_fingerprints_of_neighbours(odd, odd_rows):
    rows = sorted((i, t or "") for i, t in odd_rows)
    texts = [t for _, t in rows]
    edited = [
        t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4] for k, t in enumerate(texts)
    ]
    own, new = simhash.fingerprints(pa.array(texts)), simhash.fingerprints(pa.array(edited))
    got = {r.doc_id: r for r in simhash.document_fingerprints(odd).collect()}
    assert len(got) == len(rows)
    distinct = {int(x) for x in own}
    for k, (i, text) in enumerate(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited[k]))
        assert (r.fingerprint, r.edited_fingerprint) == (f"{own[k]:016x}", f"{new[k]:016x}")
        after = int(own[(k + 1) % len(rows)])
        assert r.near_next == 1 - (int(own[k]) ^ after).bit_count() / 64
        assert r.near_edited == 1 - (int(own[k]) ^ int(new[k])).bit_count() / 64
        near = sum(0 < (int(own[k]) ^ y).bit_count() <= 3 for y in distinct)
        assert r.n_near == near


def test_fingerprints_are_the_signs_of_the_votes(odd_rows):
    texts = [t for _, t in odd_rows if len(t or "") < 20_000]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts, pa.string()))] == [brute.simhash(t) for t in texts]


def test_rows_without_id_are_dealt_among_tasks(spark):
    rows = spark.range(0, 3000, 1, 4).selectExpr("IF(id % 3 = 0, id, NULL) AS doc_id", "concat('some words and ', id, ' number') AS text")
    got = simhash.neighbour_fingerprints(rows).collect()
    assert len(got) == 3000
    keys = [(i is not None, i or 0, h, t) for i, t, h in rows.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    texts = [k[3] for k in sorted(keys)]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % 3000][: len(t) // 4] for k, t in enumerate(texts)]
    assert sorted(r.edited_sha256 for r in got) == sorted(map(brute.sha, edited))
    parts = rows.selectExpr("doc_id", "xxhash64(text) AS deal").repartitionByRange(4, "doc_id", "deal")
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert max(sizes) < 1500


def test_block_tables_find_every_pair(spark):
    rnd = random.Random(1)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    for x in prints[:100]:
        for flips in (1, 2, 3, 4):
            y = x
            for bit in rnd.sample(range(64), flips):
                y ^= 1 << bit
            prints.append(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed * 2], "print long")
    got = {frozenset((r.a, r.b)) for r in simhash.within_radius(df).collect()}
    want = {
        frozenset((a, b)) for k, a in enumerate(signed) for b in signed[:k] if 0 < ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    }
    assert got == want and len(want) >= 300


def test_fingerprints_of_nameless_and_no_rows(spark, nameless, nothing):
    rows = simhash.document_fingerprints(nameless).collect()
    assert len(rows) == 7 and sum(r.doc_id is None for r in rows) == 2
    assert simhash.document_fingerprints(nothing).count() == 0
    one = simhash.document_fingerprints(nothing.unionByName(spark.createDataFrame([(5, "a b c d", "en")], nothing.schema)))
    assert [(r.doc_id, r.near_next) for r in one.collect()] == [(5, 1.0)]


def near_texts():
    """A group of near copies with few to many edits, boilerplate on otherwise different texts, short texts."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rnd.choices(vocabulary, k=150)
    rows = [" ".join(base)]
    for _ in range(120):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randrange(8)):
            copy[at] = rnd.choice(vocabulary)
        rows.append(" ".join(copy))
    passage = rnd.choices(vocabulary, k=60)
    for size in [2, 5, 8, 10, 12, 200] * 10:
        rows.append(" ".join(passage + rnd.choices(vocabulary, k=size)))
    for _ in range(60):
        rows.append(" ".join(rnd.choices(vocabulary[:3], k=rnd.randrange(1, 7))))
    chain = rnd.choices(vocabulary, k=200)
    for step in range(15):
        chain = chain[2:] + rnd.choices(vocabulary, k=2)
        rows.append(" ".join(chain).upper() if step % 2 else "\n".join(chain))
    return rows


def test_near_duplicates(spark, odd, odd_rows):
    rows = odd_rows + [(200_000 + i, t) for i, t in enumerate(near_texts())]
    extra = spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string")
    want = brute.near_components(rows)
    got = bottomk.near_duplicates(odd.select("doc_id", "text").unionByName(extra)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 80


def test_keep_one(spark, nameless, nothing):
    docs = nameless.withColumn("kept_key", bottomk.F.lit("x"))
    kept = bottomk.keep_one(docs)
    assert kept.columns == docs.columns
    rows = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [i for i, _ in rows] == [0, 1, 2, 3] and rows[0][1] == rows[2][1] == ""
    ids = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert bottomk.keep_one(ids).count() == 1
    assert bottomk.near_duplicates(nothing).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 499), (499, 700), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 499 for i in (499, 500, 700)}
