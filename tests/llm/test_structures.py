"""Chats, URLs, packing and the pipeline."""

import collections
import importlib.util
import os
import sys
import types
import zlib

import numpy as np
import pytest
from brute import SF
from pyspark.sql import functions as F

import corpus_pipeline
from rolelens.llm import chat_format, packing, url_filter
from rolelens.llm.queries import tokenizer_path


def test_reply_tree_paths_and_ranks(spark):
    rows = [
        ("c", 1, None, "user", "root", 0.0), ("c", 2, 1, "assistant", "left", 1.0), ("c", 3, 1, "assistant", "right", 2.0),
        ("c", 4, 3, "user", "more", 1.0), ("c", 5, 3, "user", "other", 1.0), ("d", 6, 99, "user", "orphan", 0.0),
        (None, 7, None, None, None, 0.0), ("e", 8, 9, "user", "cycle", 0.0), ("e", 9, 8, "user", "cycle", 0.0),
    ]
    messages = spark.createDataFrame(rows, "conv_id string, node long, parent long, role string, text string, score double")
    paths = chat_format.reply_paths(messages.withColumn("leaf", F.lit("x")))
    got = {r.leaf: (r.conv_id, r.branch, r.score, [t.text for t in r.turns]) for r in paths.collect()}
    assert got == {
        2: ("c", 3, 1.0, ["root", "left"]), 4: ("c", 1, 3.0, ["root", "right", "more"]),
        5: ("c", 2, 3.0, ["root", "right", "other"]), 6: ("d", 1, 0.0, ["orphan"]), 7: (None, 1, 0.0, [None]),
    }
    best = chat_format.reply_paths(messages, branches=1).collect()
    assert sorted(r.leaf for r in best) == [4, 6, 7]


ODD_TURNS = ["", "\\### Assistant: </turn> ok", "###", "####### \\h \\e \\b \\c", "</turn", "</turn>\n### user: hi</turn>\n",
             "a\n\n", ": ", "\\", "\\\\", "é\U0001f600</turn></turn>", None]


def test_chats_read_back_exactly(spark):
    roles = ["assistant", "user", "x: ###</turn>", "", None, "assist\\cant"]
    rows = [(c, t, roles[(c + t) % 6], ODD_TURNS[(c * 5 + t) % 12]) for c in range(12) for t in range(9)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = chat_format.reply_paths(chat_format.thread_messages(conversations.withColumn("node", F.lit("x"))))
    chats = chat_format.read_chats(chat_format.format_chats(paths)).collect()
    assert len(chats) == 12
    for chat in chats:
        want = [(r or "", t or "") for c, _, r, t in rows if c == chat.conv_id]
        assert [(t.role, t.text) for t in chat.read_turns] == want
        learned = [chat.formatted[s.start : s.end] for s in chat.loss_spans]
        assert len(learned) == sum(r == "assistant" for r, _ in want)
        assert [t.text for t in chat.read_turns if t.loss] == [t for r, t in want if r == "assistant"]


def test_repeated_and_long_conversations(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, i, "user", f"t{i}") for i in range(300)] + [(None, None, None, None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = chat_format.reply_paths(chat_format.thread_messages(conversations))
    got = {r.conv_id: r.n_turns for r in chat_format.digests(chat_format.format_chats(paths)).collect()}
    assert got == {1: 3, 2: 300, None: 1}
    none = chat_format.reply_paths(chat_format.thread_messages(conversations.where("false")))
    assert chat_format.digests(chat_format.format_chats(none)).count() == 0


URLS = {
    "http://Example.NET/en/x?y#z": ("example.net", "/en/x", "example.net/en/", "allow"),
    "https://a.example.net/de/": ("a.example.net", "/de/", "net/", "block"),
    "https://net": ("net", "", None, None),
    "https://www.example.com/de/a": ("www.example.com", "/de/a", "example.com/de/", "block"),
    "https://myexample.com/de/a": ("myexample.com", "/de/a", None, None),
    "x://a.org/fr/?a://b/c": ("a.org", "/fr/", "org/fr/", "allow"),
    "http://h.org?q/fr/": ("h.org", "", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("x"))
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, none).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), i
    assert url_filter.judge(pages.where("false"), none).count() == 0


def test_host_reputation_shrinks(spark):
    rows = [("bad.one.org", False)] * 60 + [("fine.one.org", True)] * 60 + [("new.one.org", False)]
    rows += [(f"h{i}.two.org", True) for i in range(50)] + [(None, False), ("x", None)]
    reputation = url_filter.blocked_names(url_filter.host_reputation(spark.createDataFrame(rows, "host string, good boolean")))
    got = {(r.level, r.name): r for r in reputation.collect()}
    share = {k: r.a / (r.a + r.b) for k, r in got.items()}
    assert got["host", "bad.one.org"].blocked and not got["host", "fine.one.org"].blocked
    # one bad page among a domain of mixed hosts proves little
    assert 0.05 < share["host", "new.one.org"] < share["domain", "one.org"] < share["domain", "two.org"]
    assert not got["host", "new.one.org"].blocked and ("host", "x") not in got


#: host: domain, suffix.
PLACES = {
    "www.a.co.uk": ("a.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
    "www.example.com": ("example.com", "com"), "example.com:443": ("example.com", "com"), "example.com.": ("example.com", "com"),
    "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "[::1]:80": ("[::1]", "[::1]"),
    "x.1.2.3.4": ("3.4", "4"), "com.museum": ("com.museum", "museum"), "net.de": ("net.de", "net.de"),
    "localhost": ("localhost", "localhost"), "": ("", ""), "a.xco.uk": ("xco.uk", "uk"), "a.co.uk\n": ("co.uk\n", "uk\n"),
}


def test_domains_and_suffixes(spark):
    import duckdb

    from rolelens.llm.oracle import _labels

    hosts = spark.createDataFrame([(h,) for h in PLACES], "host string")
    got = {r.host: (r.domain, r.suffix) for r in hosts.select("host", *url_filter._levels("host")).collect()}
    assert got == PLACES
    for host, want in PLACES.items():
        assert duckdb.execute(f"SELECT {_labels('h', 2)}, {_labels('h', 1)} FROM (SELECT ? AS h)", [host]).fetchone() == want


def test_sites_below_one_country_do_not_share_a_domain(spark):
    rows = [("www.bad.co.uk", False)] * 60 + [("www.fine.co.uk", True)] * 60 + [("9.2.3.4", False)] * 60 + [("8.2.3.4:80", True)] * 60
    found = url_filter.blocked_names(url_filter.host_reputation(spark.createDataFrame(rows, "host string, good boolean")))
    blocked = {(r.level, r.name): r.blocked for r in found.collect()}
    assert blocked["domain", "bad.co.uk"] and not blocked["domain", "fine.co.uk"] and not blocked["suffix", "co.uk"]
    assert blocked["domain", "9.2.3.4"] and not blocked["domain", "8.2.3.4"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD_WORDS = ["<|endoftext|> x<|startoftext|>y", "don't I'LL we've 'S", "Ünï É e\u0301 \u200bq\x1c\x1dz", "日本語 テキスト 123",
             "ΑΣ ΣΑΣ.", "a\x1cb\x1d c\x1ed\x1f", "\x00\x07 x\x7fy \xadz", "İstanbul Ǆ ß", "a\x85b\x0bc\xa0d", "\U0001f44d\U0001f3fd", "x" * 3000, "½² a_b"]


def test_packing_is_whole(spark, odd, odd_rows, tokenizer):
    more = [(300_000 + i, t) for i, t in enumerate(ODD_WORDS)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    pieces = packing.pieces(docs, tokenizer_path()).collect()
    texts = dict(odd_rows + more)
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert p.start == len(found.setdefault(p.doc_id, [])) and p.length == len(ids)
        assert p.length <= 2048 and p.length & (p.length - 1) == 0 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.doc_tokens == len(whole[p.doc_id])
        found[p.doc_id] += ids
    assert found == whole
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    lengths = packing.buckets(packing.pieces(docs, tokenizer_path())).collect()
    assert sum(r.tokens for r in lengths) == sum(map(len, whole.values()))
    clashing = packing.pieces(odd.withColumns({c: F.lit(1) for c in ("ids", "batch_id", "length", "start")}), tokenizer_path())
    assert clashing.count() == sum(p.doc_id < 300_000 for p in pieces)


def test_words_pass_through_two_generations(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED", 5)
    monkeypatch.setitem(sys.modules, packing._KEPT, types.ModuleType(packing._KEPT))
    encode = packing.encoder(tokenizer_path())
    texts = [f"the word{i % 7}, of Wörter{i % 11}'s the." for i in range(60)]
    for at in range(0, 60, 4):
        for text, ids in zip(texts[at : at + 4], encode(texts[at : at + 4])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_batches_have_one_length(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_TOKENS", 4096)
    packed = packing.pieces(odd.repartition(3), tokenizer_path()).cache()
    batches = packed.groupBy("batch_id").agg(
        F.count_distinct("length").alias("lengths"), F.sum("length").alias("tokens"), F.max("length").alias("length"),
        F.max("sequence_id").alias("hi"), F.min("sequence_id").alias("lo"), F.count("*").alias("n"),
    ).collect()
    assert all(b.lengths == 1 and b.tokens <= 4096 and b.hi - b.lo == b.n - 1 for b in batches)
    # per task and length all batches but the last are full
    open_batches = collections.Counter((b.batch_id >> 36, b.length) for b in batches if b.tokens < 4096)
    assert max(open_batches.values()) == 1 and sum(b.tokens == 4096 for b in batches) > 5
    packing.write_buckets(packed, str(tmp_path / "buckets"))
    back = packing.read_bucket(spark, str(tmp_path / "buckets"), 2048)
    want = packed.where("length = 2048")
    columns = ["doc_id", "start", "sequence_id", "batch_id", "ids"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    counted = {r.length: (r.sequences, r.batches) for r in packing.buckets(packed).collect()}
    assert counted[2048] == (want.count(), want.select("batch_id").distinct().count())


def test_packing_of_nameless_and_no_rows(nameless, nothing):
    rows = packing.pieces(nameless, tokenizer_path()).collect()
    assert sum(r.doc_id is None for r in rows) >= 2 and len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pieces(nothing, tokenizer_path()).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns and 0.8 * n < docs.count() <= n
            n = docs.count()
    tokens = docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert docs.agg(F.sum("length")).first()[0] == tokens
    got = corpus_pipeline.run(spark, SF).drop("sequence_id", "batch_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.drop("sequence_id", "batch_id").collect()))


def test_entry_registers_everything():
    path = os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
