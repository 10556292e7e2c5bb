"""Ranked search, periodic runs and quality rules against plain Python."""

import collections
import math
import random
import re

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolelens.llm import divergence, fptree, grams, periodic_runs, queries


# --- ranked search ------------------------------------------------------------------------------


def ranked(docs, items, k=20):
    """docs: (id, text), items: (id, text) -> {item: [(rank, doc, score)]}."""
    lists = [(i, B.words(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n, total = len(lists), sum(len(w) for _, w in lists)
    df = collections.Counter(x for _, w in lists for x in set(w))
    out = {}
    for item, text in items:
        found = []
        for i, w in lists:
            tf, m = collections.Counter(w), 75 + 25 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
                for x in B.words(text)
                if tf[x]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item] = [(r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def by_item(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


def test_ranking_of_odd_texts(spark, odd, odd_rows):
    items = [(1, "word1 tail2 all rights RESERVED"), (2, "the of and the a"), (3, None), (4, "zzzz"), (5, "!!"),
             (6, "word5 " * 9), (7, odd_rows[-1][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)).withColumn("n", F.lit(0))
    got = by_item(fptree.ranking(odd, asked))
    want = {i: v for i, v in ranked(odd_rows, items).items() if v}
    assert got == want and 4 not in got and len(got[7]) == 20


@pytest.mark.parametrize("blocks", [False, True])
def test_ranking_of_copies_ties_and_small_trees(spark, monkeypatch, blocks):
    rng = random.Random(5)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(120)]
    docs = [(i, texts[min(rng.randrange(200), 119)]) for i in range(700)] + [(None, texts[119])] * 30 + [(3, texts[0])]
    items = [(f"i{j}", " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for j in range(25)]
    items.append(items[0])
    for name, value in (("TREE_ROWS", 64), ("LEAF_ROWS", 3), ("SEEDS", 4), ("BLOCK_BYTES", 200 if blocks else 1 << 22)):
        monkeypatch.setattr(fptree, name, value)
    got = by_item(fptree.ranking(
        spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    ))
    want = ranked(docs, dict(items).items())
    assert got == {i: sorted(v) for i, v in want.items() if v}


def test_branches_are_left_out():
    """With a good first bound most documents are never scored, and the ranking is the same."""
    rng = np.random.default_rng(1)
    size, terms = 4000, 200
    rows = [np.unique(np.minimum(rng.geometric(0.05, 12), terms) - 1) for _ in range(size)]
    ptr = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    names, counts = np.concatenate(rows).astype(np.int64), np.ones(ptr[-1], np.int64)
    tree = fptree.Tree(list(range(size)), np.full(size, 100, np.int64), ptr, names, names, counts)
    wanted = np.zeros(terms, np.int64)
    wanted[[1, 90, 95]] = [10, 4000, 4500]
    seen = []
    rated = fptree.Node.rated
    try:
        fptree.Node.rated = lambda node, w: seen.append(len(node.documents)) or rated(node, w)
        best = []
        fptree.search(tree.root, wanted, best, 1, 5)
    finally:
        fptree.Node.rated = rated
    scores = sorted((int(wanted[r].sum()) * (10**9 // (1000 + 1200)) for r in rows), reverse=True)
    assert sorted((s for s, _ in best), reverse=True) == scores[:5] and sum(seen) < size / 2


def test_ranking_of_nothing(spark, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert fptree.ranking(nothing, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fptree.ranking(some, items.where("item_id = 2")).columns == ["item_id", "rank", "doc_id", "score"]
    assert fptree.ranking(some, items.where("item_id = 2")).count() == 0


# --- periodic runs ------------------------------------------------------------------------------


def all_runs(w):
    """(start, length, period) of all runs, by trying every period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, part = j + q - i, w[i : j + q]
            if size >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def run_row(doc_id, text):
    w = blanks(text)
    h, n = (B.crc(doc_id), len(w)) if doc_id is not None else (1, 0)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *top, top[0] is not None and 1000 * top[1] // top[2] or None,
        B.sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        B.sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    rng = random.Random(2)
    total = 0
    for case in range(1500):
        n = rng.randint(0, 60) if case % 4 else rng.randint(60, 300)
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 8 else 0):
            s = rng.randrange(n)
            q = rng.randint(1, max(1, (n - s) // 3))
            for i in range(s + q, min(n, s + q * rng.randint(3, 9) + rng.randint(0, q))):
                w[i] = w[i - q]
        want = all_runs(w)
        total += len(want)
        assert periodic_runs.runs(grams.word_codes([b"%d" % x for x in w])) == want, w
    assert total > 1000


def test_runs_whose_period_repeats_every_sequence():
    """Each short sequence of the period comes twice in it, so its next occurrence never is one period away."""
    a, b = [0, 0, 0, 1, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1, 0, 1]
    period = a + b
    assert periodic_runs.runs(np.array(period * 5)) == all_runs(period * 5)
    assert (0, 80, 16) in periodic_runs.runs(np.array(period * 5))


def test_one_word_and_long_periods():
    assert periodic_runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    period = np.random.default_rng(3).integers(0, 10**6, 5000)
    assert periodic_runs.runs(np.tile(period, 5)[:22_000]) == [(0, 22_000, 5000)]


def test_runs_query_and_odd_texts(spark, odd, odd_rows):
    got = periodic_runs.periodic_runs(odd, edit=True).select(*RUN_COLUMNS).collect()
    small = [(i, t) for i, t in odd_rows if len(t or "") < 4000]
    want = {r[0]: r for r in (run_row(i, t) for i, t in small)}
    assert len(got) == len(odd_rows) and len(want) > 150
    for r in got:
        assert tuple(r) == want.get(r.doc_id, tuple(r))
    edited = [i for i, _ in small if B.crc(i) % 10 == 0]
    assert edited and any(want[i][1] for i in edited)
    assert queries.op12_periodic_runs(spark, B.SF).columns[:8] == RUN_COLUMNS


def test_runs_of_repeated_rows_and_collapse(spark, nameless, nothing):
    got = sorted(map(tuple, periodic_runs.periodic_runs(nameless, edit=True).select(*RUN_COLUMNS).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in nameless.collect()]
    assert got == sorted((run_row(i, t) for i, t in rows), key=str)
    assert periodic_runs.periodic_runs(nothing).count() == 0
    docs = spark.createDataFrame([(1, "so so so so so so it\ngoes", "x"), (2, " a  b ", None), (3, None, "y")], "doc_id int, text string, runs string")
    assert [tuple(r) for r in periodic_runs.collapse(docs).orderBy("doc_id").collect()] == [
        (1, "so it goes", "x"), (2, " a  b ", None), (3, None, "y"),
    ]


# --- quality rules ------------------------------------------------------------------------------


def base_row(text):
    text = text or ""
    w = blanks(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if blanks(line):
            dup += line in lines
            lines.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 20 or 100 * len(again) > 30 * n)


def shares(counter, names):
    total = sum(counter.values())
    return [counter[x] / total for x in names]


def js(p, q):
    def kl(a):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, q if a is p else p) if x)

    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def char_class(c):
    for i, kind in enumerate((r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[!-~]", r"[\x00-\x7f]")):
        if re.fullmatch(kind, c):
            return i
    return 7


def verdicts(rows):
    """rows: (id, text, lang). The whole rule, by plain histograms."""
    chars, words = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    own = []
    for _, text, lang in rows:
        c = collections.Counter(map(char_class, text or ""))
        w = collections.Counter(B.words(text))
        own.append((c, w))
        chars[lang] += c
        words[lang] += w
    out = []
    for (i, text, lang), (c, w) in zip(rows, own):
        base = base_row(text)
        dc = dw = None
        total = sum(words[lang].values())
        if total >= divergence.MIN_REFERENCE:
            if c.total() >= 200:
                dc = js(shares(c, range(8)), shares(chars[lang], range(8)))
            if w.total() >= 50:
                common = [x for x, n in words[lang].items() if n >= divergence.MIN_SHARE * total]

                def hist(counter, common=common):
                    part = [counter[x] for x in common]
                    return [x / counter.total() for x in (*part, counter.total() - sum(part))]

                dw = js(hist(w), hist(words[lang]))
        far = (dc is not None and dc > 0.25 + 1 / c.total() ** 0.5) or (dw is not None and dw > 0.25 + 2 / w.total() ** 0.5)
        out.append((i, *base, not base[-1] and not far, dc, dw))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: str(r[:7])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:8] == w[:8]
        for a, b in zip(g[8:], w[8:]):
            assert a == b or math.isclose(a, b, abs_tol=1e-6), (g, w)


def test_quality_against_plain_histograms(spark):
    table = spark.read.parquet(f"{B.SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()]
    got = queries.op13_quality_rules(spark, B.SF.replace("0.001", "0.01")).collect()
    same(got, verdicts(rows))
    kept = sum(r.kept for r in got)
    assert kept < sum(not r.base_failed for r in got) and kept > 0.8 * len(got)


def test_quality_of_odd_texts(spark, odd, odd_rows):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("xx")))
    rows = [(i, t, "xx" if i % 3 else None) for i, t in odd_rows]
    same(divergence.quality(docs).collect(), verdicts(rows))


def test_quality_with_bounded_memory_and_many_languages(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(400):
        lang = f"l{i % 7}"
        w = rng.choices(common, k=60) + [f"{lang}x{rng.randrange(10**6)}" for _ in range(60)]
        rng.shuffle(w)
        rows.append((i, " ".join(w).upper() if i % 97 == 0 else " ".join(w), lang))
    for name, value in (("HELD_WORDS", 300), ("LANGUAGES", 2), ("MIN_REFERENCE", 5000)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3)
    got = divergence.quality(docs).collect()
    same(got, verdicts(rows))
    assert {r.doc_id for r in got if not r.kept} == {i for i, _, _ in rows if i % 97 == 0}


def test_quality_of_nothing_and_repeated_rows(spark, nothing, nameless):
    assert divergence.quality(nothing).count() == 0
    rows = [(r.doc_id, r.text, None) for r in nameless.collect()]
    same(divergence.quality(nameless.withColumn("lang", F.lit(None).cast("string"))).collect(), verdicts(rows))
