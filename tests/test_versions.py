"""Commits: staged loads, concurrent writers, former versions, content checksums."""

import threading

import pytest
from pyspark.sql import functions as F
from rows import rental, table, values

from rolelens.operators import policy as P
from rolelens.operators.stored import StoredRegistry
from rolelens.schema import RENTAL_COLUMNS
from rolelens.sources import load as L
from rolelens.sources.versions import VersionedTable


@pytest.fixture
def csv(spark, tmp_path):
    rows = table(spark, *[rental(i, district="AB"[i % 2]) for i in range(20)])
    rows.write.option("header", True).csv(str(tmp_path / "csv"))
    return str(tmp_path / "csv")


def test_repeated_replaced_and_former_loads(spark, csv, tmp_path):
    path = str(tmp_path / "table")
    assert L.load_staged(spark, csv, path, "a").read().count() == 20
    assert L.load_staged(spark, csv, path, "a").versions() == [1]
    assert L.load_staged(spark, csv, path, "b").read().count() == 40
    done = L.load_staged(spark, csv, path, "c", replace=True)
    assert done.read().count() == 20 and done.versions() == [1, 2, 3]
    assert [done.read(v).count() for v in (1, 2, 3)] == [20, 40, 20]
    assert L.load_staged(spark, csv, path, "b").versions() == [1, 2, 3]
    with pytest.raises(ValueError):
        done.read(4)
    assert VersionedTable(spark, str(tmp_path / "none"), done.schema).read().count() == 0


def test_a_failed_load_leaves_the_table(spark, csv, tmp_path):
    path = str(tmp_path / "table")
    before = L.load_staged(spark, csv, path, "a")
    bad = before.read().withColumn("district", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        before.commit(bad, "b", replace=True)
    assert before.read().count() == 20 and before.versions() == [1]
    before.commit(before.read(), "b")
    assert before.read().count() == 40


def test_a_table_is_replaced_without_a_gap(spark, csv, tmp_path):
    rows = L.accepted(L.csv_scan(spark, csv))
    path = str(tmp_path / "t")
    L.replace_table(spark, "swapped", path)
    L.load_insert(L.csv_scan(spark, csv), "swapped")
    try:
        bad = rows.withColumn("district", F.raise_error(F.lit("broken")).cast("string"))
        with pytest.raises(Exception, match="broken"):
            L.replace_table(spark, "swapped", path, rows=bad)
        assert spark.table("swapped").count() == 20
        assert L.replace_table(spark, "swapped", path, rows=rows.limit(7)).count() == 7
        assert spark.table("swapped").count() == 7
    finally:
        spark.sql("DROP TABLE IF EXISTS swapped")


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    registry = StoredRegistry(spark, str(tmp_path / "registry"))
    errors = []

    def write(i):
        try:
            registry.upsert([P.Policy(f"r{i}", f"f{i}", all_rows=True), P.Policy(f"r{i}", "shared", all_rows=True)])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and registry.versions() == [1, 2, 3, 4, 5, 6]
    names = sorted(values(registry.policies(), "name"))
    assert names == sorted([(f"f{i}",) for i in range(6)] + [("shared",)])
    last = registry._policies.read(versioned=True).where("name = 'shared'").orderBy(F.desc("_version")).first()
    assert values(registry.policies().where("name = 'shared'"), "role") == [(last.role,)]


def test_stored_policies_and_grants(spark, tmp_path):
    data = table(spark, rental(1), rental(2, district="B"))
    registry = StoredRegistry(spark, str(tmp_path / "registry"))
    registry.upsert(P.standard_policies("A"), data)
    registry.grant(P.role_grants(registry.policies()))
    assert registry.open_table(data, P.DISTRICT_ANALYST).count() == 1
    registry.upsert([P.Policy(P.DISTRICT_ANALYST, "district_filter", row_filter="district = 'B' OR district = 'A'")])
    assert registry.open_table(data, P.DISTRICT_ANALYST).count() == 2
    assert values(registry.policies(1).where("name = 'district_filter'"), "row_filter") == [("district = 'A'",)]
    registry.revoke(registry.grants().where("role = 'operation'"))
    with pytest.raises(PermissionError):
        registry.open_table(data, P.OPERATION)
    registry.drop(P.TABLE, "steward_filter")
    registry.drop(P.TABLE, "steward_filter")
    before = sorted(map(str, registry.policies().collect()))
    registry.compact()
    assert sorted(map(str, registry.policies().collect())) == before and len(before) == 3
    with pytest.raises(PermissionError):
        registry.open_table(data, P.STEWARD)
    registry.upsert(P.standard_policies("A"))
    assert registry.open_table(data, P.STEWARD).count() == 2


def test_an_altered_value_is_found(spark, csv, tmp_path):
    source = L.csv_scan(spark, csv)
    loaded = L.load(spark, csv, str(tmp_path / "plain"))
    assert L.content_reconcile(source, loaded.repartition(3)).where("NOT ok").count() == 0
    changed = loaded.withColumn("usage_min", F.when(F.col("rental_id") == "r7", 9).otherwise(F.col("usage_min")))
    bad = L.content_reconcile(source, changed).where("NOT ok").collect()
    assert len(bad) == 1 and bad[0].low <= "r7" <= bad[0].high and bad[0].source_rows == bad[0].loaded_rows
    moved = loaded.withColumns({"station_name": F.col("gender"), "gender": F.col("station_name")}).select(*RENTAL_COLUMNS)
    assert L.content_reconcile(source, moved).where("ok").count() == 0
    twice = loaded.unionByName(loaded.where("rental_id = 'r3'"))
    assert values(L.content_reconcile(source, twice).where("NOT ok"), "loaded_rows", "source_rows")[0][0] >= 2
    assert L.content_reconcile(source, loaded.where("rental_id <> 'r3'")).where("NOT ok").count() == 1
