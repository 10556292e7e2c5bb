"""License scans, decontamination and personal data against plain Python."""

import brute
import pytest
from brute import SF

from rolelens.llm import decontaminate, license_scan, pii


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_licenses(odd, odd_rows):
    got = by_id(license_scan.licenses(odd))
    assert len(got) == len(odd_rows)
    for i, text in odd_rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    notice = got[100_006]
    assert notice.labels == "apache-2.0,cc-by,reserved" and notice.score == 1.0 and notice.n_base == 4


def test_licenses_bridge_small_edits(spark):
    bsd = license_scan.NOTICES[1].text
    edited = bsd.replace("source and binary", "source and also in binary").replace("following", "next")
    rows = [(1, edited), (2, "released under the old license"), (3, bsd[: len(bsd) // 3]), (4, f"x {bsd} y {bsd}")]
    got = by_id(license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].labels == "bsd" and 0.8 <= got[1].score < 1
    assert (got[2].labels, got[3].labels, got[4].labels) == ("", "", "bsd")


def test_licenses_of_nameless_and_no_rows(nameless, nothing):
    rows = license_scan.licenses(nameless).collect()
    assert len(rows) == 7 and {r.n_base for r in rows} == {0}
    assert license_scan.licenses(nothing).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "alone"), (None, "no id for these words here"), (7, None), (8, ""), (9, "Word3 tail3 word4 tail4")]
    extra = spark.createDataFrame(items, "item_id long, text string")
    return spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(extra)


def test_contamination(spark, odd, odd_rows, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.where("item_id IS NOT NULL").collect()]
    got = by_id(decontaminate.contamination(odd, benchmark))
    assert len(got) == len(odd_rows)
    for i, text in odd_rows:
        if len(text or "") < 20_000:
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.contamination(text, items), i
    assert sum(r.contaminated for r in got.values()) >= 5 and got[100_011].contaminated


def test_contamination_without_broadcast(spark, odd, odd_rows, nameless, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    got = by_id(decontaminate.contamination(odd, benchmark))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert len(got) == len(odd_rows)
    hit = 0
    for i, text in odd_rows:
        r = got[i]
        if len(text or "") < 20_000:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.contamination(text, items), i
        hit += r.contaminated
    assert hit > 0 and decontaminate.contamination(nameless, benchmark).count() == 7


def test_shuffle_without_broadcast_grows_with_the_text(spark, benchmark, monkeypatch):
    """What the windows' side of the join holds of a row does not contain its words."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "doc_id long, text string")
    plan = decontaminate.contamination(docs, benchmark)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.split("\n") if "Generate explode" in line and "hash" in plan]
    assert generated and "BroadcastHint" not in plan
    places = [line for line in plan.split("\n") if "Project [_row" in line and ".hash AS hash" in line]
    assert places and all("words" not in line.split("[", 1)[1] for line in places)


def test_decontaminate_drops_and_cuts(spark, benchmark):
    item = benchmark.where("item_id = 0").first().text
    rows = [(1, f"before, {item} after!"), (2, "clean text"), (3, "no id for these words here"), (4, None), (1, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bad_key", decontaminate.F.lit(1))
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "clean too"), (2, "clean text"), (4, "")]
    cut = {(r.doc_id, r.text) for r in decontaminate.cut_spans(docs, benchmark).collect()}
    assert (1, "before. after!") in cut and (1, "clean too") in cut and (3, "") in cut and (4, None) in cut


def test_contamination_of_nothing(nameless, nothing, benchmark):
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    none = benchmark.where("false")
    rows = decontaminate.contamination(nameless, none).collect()
    assert len(rows) == 7 and not any(r.contaminated for r in rows)
    assert decontaminate.decontaminate(nameless, none).count() == 7


def test_personal_data(odd, odd_rows):
    got = by_id(pii.personal_data(odd))
    assert len(got) == len(odd_rows)
    for i, text in odd_rows:
        spans = brute.pii(text)
        r = got[i]
        counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, i
        assert r.base_sha256 == brute.sha(brute.listed(spans)), i
        assert set(filter(None, brute.listed(spans).split(","))) <= set(r.spans.split(",")), i


def test_bootstrap_finds_identifiers_in_telling_contexts(spark):
    rows = [(i, f"some words then account holder card {4111111111111111 if i % 2 else 5500000000000004} ok") for i in range(4)]
    cards = ["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220000", "6011111111111117",
             "378282246310005", "30569309025904", "3530111333300000", "5105105105105100", "4000056655665556"]
    rows += [(10 + i, f"text {i} the account holder card {c} was used") for i, c in enumerate(cards)]
    rows += [(30, "and the account holder card X99-1234 was used"), (31, "in the year 1999 was used too")]
    rows += [(40 + i, f"in the year {1900 + i} it rained") for i in range(40)]
    got = by_id(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    text = rows[14][1]
    unseen = rows[[r[0] for r in rows].index(30)][1]
    at = unseen.index("X99-1234")
    assert got[30].spans == f"card:{at}:{at + 8}" and got[30].n_card == 0, text
    assert got[31].spans == "" and all(got[40 + i].spans == "" for i in range(40))


def test_redact(spark, nameless):
    rows = [(1, "mail a@b.co, call +12345678901234 now"), (2, None), (3, "é 10.0.0.1"), (4, "plain"), (1, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra_key", pii.F.lit("x"))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [
        (1, "mail <EMAIL>, call <PHONE> now"), (1, "plain"), (2, ""), (3, "é <IP>"), (4, "plain"),
    ]
    assert pii.redact(nameless).count() == 7


def test_personal_data_of_nothing(nameless, nothing):
    assert pii.personal_data(nothing).count() == 0
    assert len(pii.personal_data(nameless).collect()) == 7
