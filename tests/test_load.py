"""CSV load, tables, reconciliation and log parsing."""

import datetime
from decimal import Decimal

import pytest

from rolelens.schema import RENTAL_SCHEMA
from rolelens.sources import load as L
from rolelens.sources.logs import log_metrics

HEADER = (
    "rental_id,station_id,station_name,rental_date,return_date,usage_min,distance_meter,birth_year,"
    "gender,user_type,district,usage_min_numeric,distance_numeric,birth_year_numeric"
)
LINES = (
    'a,1,"b,c",2024-12-01 13:55:19,2024-12-01 14:01:57,6,661.11,1998,F,local,D,6,661.11,1998',
    "b,2,x,bad,2024-12-02 08:40:39,six,1650.0,,,local,,5,1650.0,",
    "c,,x,2024-12-02 08:35:22,2024-12-02 08:40:39,5,1,1996,M,local,D,5,1,1996",
    "d,4,x,,2024-12-02 08:40:39,5,1,1996,M,local,D,5,1,1996",
    ",,x,,,5,1,1996,M,local,D,5,1,1996",
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "rentals.csv"
    path.write_text("\n".join((HEADER, *LINES)) + "\n", encoding="utf-8")
    return str(path)


def test_load_and_reconcile(spark, csv, tmp_path):
    raw = L.csv_scan(spark, csv)
    assert len(raw.columns) == 11 and raw.count() == 5
    stored = L.load(spark, csv, str(tmp_path / "stored"))
    assert [f.dataType for f in stored.schema] == [f.dataType for f in RENTAL_SCHEMA]
    rows = {r.rental_id: r for r in stored.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].station_name == "b,c"
    assert rows["a"].rental_date == datetime.datetime(2024, 12, 1, 13, 55, 19)
    assert rows["a"].distance_meter == Decimal("661.11")
    assert rows["b"].rental_date is None and rows["b"].usage_min is None
    assert rows["b"].birth_year is None and rows["b"].district is None
    got = L.load_reconcile(raw, stored).first()
    assert (got.source_rows, got.loaded_rows, got.rejected_rows, got.ok) == (5, 2, 3, True)
    assert (got.missing_rental_id, got.missing_station_id, got.missing_rental_date) == (1, 2, 2)
    assert L.load_reconcile(raw, stored.limit(1)).first().ok is False


def test_tables(spark, csv, tmp_path):
    path = str(tmp_path / "table")
    L.replace_table(spark, "load_test", path)
    assert L.table_scan(spark, "load_test").count() == 0
    raw = L.csv_scan(spark, csv)
    assert L.load_insert(raw, "load_test").count() == 2
    assert L.load_insert(raw, "load_test").count() == 4
    L.replace_table(spark, "load_test", path)
    assert spark.table("load_test").count() == 0
    report = [(r.position, r.name, r.type) for r in L.schema_report(spark.table("load_test")).collect()]
    assert report[0] == (1, "rental_id", "string") and report[6] == (7, "distance_meter", "decimal(12,2)")
    spark.sql("DROP TABLE load_test")


def test_preview(spark, csv):
    rows = L.preview(L.csv_scan(spark, csv).dropna(subset=["rental_id"]), 2).collect()
    assert [r.rental_id for r in rows] == ["a", "b"]


def test_log_metrics(spark, tmp_path):
    logs = {
        "full": "x\n✅ 필터링 후 레코드 수: 100,000건\nroot\n |-- a: int\n |-- b: int\n\n |-- after\n",
        "second": "✅ 총 레코드 수: 7건\n✅ 레코드 수: 8건\n",
        "nothing": "no counts here\nroot\n |-- a: int\n",
        "junk": "✅ 레코드 수: ,건\n",
        "empty": "",
    }
    for role, text in logs.items():
        folder = tmp_path / "logs" / f"role={role}"
        folder.mkdir(parents=True)
        (folder / "stdout").write_text(text, encoding="utf-8")
    got = {r.role: (r.records, r.columns) for r in log_metrics(spark, str(tmp_path / "logs")).collect()}
    assert got == {"full": (100000, 2), "second": (7, 0), "nothing": (0, 0), "junk": (0, 0)}
    roles = spark.createDataFrame([("full",), ("nothing",), ("empty",), ("absent",)], "role string")
    listed = {r.role: (r.log_available, r.records) for r in log_metrics(spark, str(tmp_path / "logs"), roles).collect()}
    assert listed == {"full": (True, 100000), "nothing": (True, 0), "empty": (False, 0), "absent": (False, 0)}


def test_long_logs_are_read_by_line(spark, tmp_path):
    folder = tmp_path / "logs" / "role=r"
    folder.mkdir(parents=True)
    body = "filler |-- line\n" * 20_000
    (folder / "stdout").write_text(f"{body}✅ 레코드 수: 5건\nroot\n |-- a\n{body}\n{body}✅ 레코드 수: 6건\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        row = log_metrics(spark, str(tmp_path / "logs")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (row.records, row.columns) == (5, 20_001)


def test_reconcile_with_one_key(spark):
    source = spark.createDataFrame([("a",), (None,)], "k string")
    got = L.load_reconcile(source, source.where("k IS NOT NULL"), ["k"]).first()
    assert (got.source_rows, got.rejected_rows, got.missing_k, got.ok) == (2, 1, 1, True)
