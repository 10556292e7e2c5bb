"""Tables in a global order, and merges that rewrite only what changes."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import rental, table

from rolelens.operators.quality import dedupe
from rolelens.schema import RENTAL_COLUMNS, RENTAL_SCHEMA
from rolelens.sources import load as L
from rolelens.sources.layout import write_clustered
from rolelens.sources.versions import VersionedTable


def scanned(df) -> int:
    """Rows that the scan of a plan without shuffles hands on, after row groups and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture
def many(spark):
    """20,000 rentals: a third in one district, the others in 50; every fifth station value is rare."""
    i = F.col("id")
    one = table(spark, rental(0)).drop("rental_id", "district", "station_id", "rental_date")
    rows = spark.range(0, 20_000, 1, 8).crossJoin(F.broadcast(one))  # one row
    return rows.select(
        F.concat(F.lit("r"), i).alias("rental_id"),
        F.concat(F.lit("s"), F.pmod(F.hash(i), F.lit(5000))).alias("station_id"),
        F.timestamp_add("MINUTE", F.pmod(F.hash(i), F.lit(100_000)), F.lit("2024-01-01").cast("timestamp_ntz")).alias("rental_date"),
        F.when(i % 3 == 0, "hot").when(i % 1000 == 1, None).otherwise(F.concat(F.lit("d"), i % 50)).alias("district"),
        *one.columns,
    ).select(*RENTAL_COLUMNS)


def test_a_district_and_a_station_are_read_alone(spark, many, tmp_path):
    stored = write_clustered(many, str(tmp_path / "t"), files=40, distinct=600)
    own = str(tmp_path / "own")
    many.repartition(40).sortWithinPartitions("district").write.parquet(own)
    former = spark.read.schema(RENTAL_SCHEMA).parquet(own)
    assert stored.exceptAll(many).isEmpty() and many.exceptAll(stored).isEmpty()
    some = F.col("district") == "d7"
    assert 0 < stored.where(some).count() < scanned(stored.where(some)) <= 2000
    assert scanned(former.where(some)) > 2000
    assert scanned(stored.where("district = 'hot'")) < 10_000
    station = many.where("district = 'd7'").first()["station_id"]
    assert 0 < scanned(stored.where(F.col("station_id") == station)) <= 8000
    # the frequent district is cut into files of like size
    sizes = [r["count"] for r in stored.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(sizes) < 4 * 500


def test_layout_of_small_tables(spark, tmp_path):
    empty = write_clustered(table(spark, rental(0)).limit(0), str(tmp_path / "e"))
    assert empty.count() == 0 and empty.columns == list(RENTAL_COLUMNS)
    rows = table(spark, rental(0, district=None), rental(0, district=None), rental(1, rental_date=None)).withColumn("id", F.lit(1))
    again = write_clustered(rows, str(tmp_path / "r"), by=("district", "rental_id"), lookup=(), files=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def rows_of(df):
    return sorted(map(str, df.select(*RENTAL_COLUMNS).collect()))


def test_merge_equals_dedupe_of_the_union(spark, tmp_path):
    stored = VersionedTable(spark, str(tmp_path / "t"), RENTAL_SCHEMA)
    loads = [
        table(spark, *[rental(i, usage_min=i) for i in range(30)], rental(3, usage_min=99), rental(3, usage_min=3)),
        table(spark, *[rental(i, usage_min=i - 1 if i % 4 else 500) for i in range(20, 40)], rental(50, rental_id=None)),
        table(spark, rental(51, rental_id=None, usage_min=1), rental(7, usage_min=None)),
        table(spark, rental(0)).limit(0),
        table(spark, *[rental(i, usage_min=i) for i in range(30)]),
    ]
    union = None
    for k, rows in enumerate(loads):
        union = rows if union is None else union.unionByName(rows)
        done = stored.merge_distinct(rows, ("rental_id",), ("usage_min",), f"load {k}")
        assert rows_of(stored.read()) == rows_of(dedupe(union, ("rental_id",), ("usage_min",)))
        assert done["version"] == k + 1
        again = stored.merge_distinct(rows, ("rental_id",), ("usage_min",), f"load {k}")
        assert again["version"] == k + 1 and again["added"] == again["replaced"] == 0
    # nothing of the last load is new or better
    assert (done["added"], done["replaced"], done["rewritten_files"]) == (0, 0, 0)
    assert stored.read(1).count() == 30 and stored.versions() == [1, 2, 3, 4, 5]


def test_merge_rewrites_only_files_that_change(spark, tmp_path):
    stored = VersionedTable(spark, str(tmp_path / "t"), RENTAL_SCHEMA)
    for part in range(5):
        rows = table(spark, *[rental(f"{part}{i:03d}", usage_min=5) for i in range(100)])
        stored.merge_distinct(rows.coalesce(1), ("rental_id",), ("usage_min",))
    better = table(spark, rental("2007", usage_min=1), rental("3001", usage_min=9), rental("9000"))
    done = stored.merge_distinct(better, ("rental_id",), ("usage_min",))
    assert (done["added"], done["replaced"]) == (1, 1)
    assert done["rewritten_files"] >= 1 and done["rewritten_rows"] <= 100
    assert stored.read().count() == 501 and stored.read(5).count() == 500
    assert stored.read().where("rental_id = 'r2007'").first()["usage_min"] == 1
    # versions of rows, and compaction, see the same table
    assert stored.read(versioned=True).count() == 501
    before = rows_of(stored.read())
    stored.compact(lambda rows: rows)
    assert rows_of(stored.read()) == before


def test_stored_copies_of_a_key_and_key_only_tables(spark, tmp_path):
    stored = VersionedTable(spark, str(tmp_path / "t"), RENTAL_SCHEMA)
    rows = table(spark, rental(1), rental(2, usage_min=9))
    stored.commit(rows)
    stored.commit(rows)
    stored.merge_distinct(rows, ("rental_id",), ("usage_min",))
    assert rows_of(stored.read()) == rows_of(rows)
    keys = T.StructType([T.StructField("k", T.DoubleType())])
    only = VersionedTable(spark, str(tmp_path / "k"), keys)
    for values in ([1.0, 2.0, None, None], [2.0, 3.0, None]):
        only.merge_distinct(spark.createDataFrame([(v,) for v in values], keys), ("k",))
    assert sorted(str(r.k) for r in only.read().collect()) == ["1.0", "2.0", "3.0", "None"]


def test_concurrent_merges_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []
    VersionedTable(spark, path, RENTAL_SCHEMA).merge_distinct(table(spark, *[rental(i) for i in range(10)]), ("rental_id",))

    def write(k):
        try:
            rows = table(spark, *[rental(i, usage_min=k) for i in range(k, k + 10)])
            VersionedTable(spark, path, RENTAL_SCHEMA).merge_distinct(rows, ("rental_id",), ("usage_min",))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.rental_id: r.usage_min for r in VersionedTable(spark, path, RENTAL_SCHEMA).read().collect()}
    want = {f"r{i}": min([6] * (i < 10) + [k for k in (1, 3, 5) if k <= i < k + 10]) for i in range(15)}
    assert not failed and got == want


def test_staged_loads_and_merges_share_a_table(spark, tmp_path):
    table(spark, *[rental(i) for i in range(5)]).write.option("header", True).csv(str(tmp_path / "csv"))
    path = str(tmp_path / "t")
    stored = L.load_staged(spark, str(tmp_path / "csv"), path, "a")
    stored.merge_distinct(table(spark, rental(1, usage_min=1), rental(8)), ("rental_id",), ("usage_min",))
    assert stored.read().count() == 6
    assert L.load_staged(spark, str(tmp_path / "csv"), path, "b", replace=True).read().count() == 5
