"""Top lists by bucket counts, and distinct counts from stored sketches."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from rows import rental, table

from rolelens.catalog import queries as Q
from rolelens.operators import policy as P
from rolelens.operators import segment as G
from rolelens.operators import sketches as D
from rolelens.operators import summary as M
from rolelens.operators.heavy import heaviest, heavy_segment
from rolelens.schema import HiddenColumnError

def by_key():
    return {"k": F.col("k")}


def exact(df, k):
    return [tuple(r) for r in df.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(k).collect()]


def test_skewed_keys_are_found_among_few(spark):
    """A third of the rows has one key, 40 keys are frequent, 60,000 keys are rare."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("f"), F.pmod(F.hash(i), F.lit(40))))
    df = spark.range(0, 180_000, 1, 8).select(key.otherwise(F.concat(F.lit("r"), i)).alias("k"))
    found = heaviest(df, by_key(), 10, buckets=4096)
    assert [tuple(r) for r in found.rows.collect()] == exact(df, 10)
    # few buckets of 4,096, and few of 60,041 keys
    assert found.opened_buckets < 200 and found.counted_keys < 3000


@pytest.mark.parametrize("buckets,first", [(1, 1), (2, 1), (16, 1), (64, 4), (4096, 1)])
def test_equal_to_a_grouping(spark, buckets, first):
    rnd = random.Random(buckets * 10 + first)
    for spread in (1.0, 0.05):
        rows = [(None if rnd.random() < 0.05 else f"k{int(rnd.paretovariate(spread)) % 300}",) for _ in range(1500)]
        df = spark.createDataFrame(rows, "k string")
        for k in (1, 7):
            assert [tuple(r) for r in heaviest(df, by_key(), k, buckets, first).rows.collect()] == exact(df, k)


def test_ties_beyond_the_opened_buckets(spark):
    """All keys have one row each, so only their order decides, and every key has to be counted."""
    df = spark.range(500).select(F.format_string("k%03d", 499 - F.col("id")).alias("k"))
    found = heaviest(df, by_key(), 5, buckets=64, first=1)
    assert [r.k for r in found.rows.collect()] == [f"k{n:03d}" for n in range(5)]
    assert found.counted_keys == 500


def test_few_or_no_keys(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    assert [tuple(r) for r in heaviest(df, by_key(), 10).rows.collect()] == [(None, 2), ("a", 1)]
    assert heaviest(df.limit(0), by_key(), 10).rows.collect() == []
    two = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    got = heaviest(two, {"x": F.col("x"), "y": F.col("y")}, 2, buckets=1).rows.collect()
    assert [tuple(r) for r in got] == [("a", None, 2), (None, "a", 1)]
    with pytest.raises(ValueError, match="collation"):
        heaviest(df.select(F.collate("k", "UNICODE_CI").alias("k")), by_key(), 1)
    with pytest.raises(ValueError):
        heaviest(df, by_key(), 0)


@pytest.mark.parametrize("name", ["station_top10", "station_popular", "station_efficiency", "district_station_hour"])
def test_reports_are_equal(spark, name):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        n = int(rnd.paretovariate(0.6)) % 60
        district = None if n == 7 else f"D{n % 4}"
        rows.append(rental(i % 350, station_id=None if n == 5 else f"s{n}", station_name=f"S{n}", district=district, usage_min=i % 9))
    df = table(spark, *rows)
    assert heavy_segment(df, name, buckets=32, first=1).collect() == G.segment(df, name).collect()


def test_further_buckets_of_a_joined_and_filtered_table(spark, tmp_path):
    """As many rows in each station of the role's district, so further buckets are opened after the fullest."""
    users = spark.range(300).withColumnRenamed("id", "user_id")
    users.selectExpr("user_id AS c_custkey", "cast(20 + user_id % 3 AS int) AS c_nationkey").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    spark.range(20, 23).selectExpr("cast(id AS int) AS n_nationkey", "concat('NATION_', id) AS n_name").write.parquet(
        f"{tmp_path}/nation.parquet"
    )
    spark.range(900).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "id % 300 AS user_id", "'view' AS event_type",
        "cast(id % 7 AS double) AS value", "'{\"k\": 2}' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = Q.QUERIES["station_top10_heavy"](spark, str(tmp_path)).collect()
    assert [r.station_id for r in got] == sorted(str(n) for n in range(0, 300, 3) if n % 50 != 49)[:10]
    assert got == Q.QUERIES["station_top10"](spark, str(tmp_path)).collect()


def test_only_top_lists_by_count(spark):
    with pytest.raises(ValueError, match="top list"):
        heavy_segment(table(spark, rental(0)), "hourly_load")
    with pytest.raises(HiddenColumnError):
        heavy_segment(table(spark, rental(0)).drop("station_id"), "station_top10")


# --- stored sketches ---

COLUMNS = ("rental_id", "station_id", "user_type")


@pytest.fixture
def many(spark):
    """30,000 rentals over three districts and ten days, some stations NULL."""
    i = F.col("id")
    one = table(spark, rental(0)).drop("rental_id", "station_id", "rental_date", "district")
    rows = spark.range(0, 30_000, 1, 4).crossJoin(F.broadcast(one))  # one row
    return rows.select(
        F.concat(F.lit("r"), i).alias("rental_id"),
        F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("s"), F.pmod(F.hash(i), F.lit(9000)))).alias("station_id"),
        F.timestamp_add("DAY", i % 10, F.lit("2024-01-01").cast("timestamp_ntz")).alias("rental_date"),
        F.when(i % 3 == 0, None).otherwise(F.concat(F.lit("d"), i % 3)).alias("district"),
        *one.columns,
    )


def test_estimates_of_scopes(spark, many, tmp_path):
    store = D.DistinctStore(spark, str(tmp_path / "s"), COLUMNS)
    half = F.pmod(F.hash("rental_id"), F.lit(2)) == 0
    assert store.add(many.where(half), "a") == 1
    assert store.add(many.where(~half), "b") == 2
    assert store.add(many, "a") == 2  # a load counts once
    wheres = [None, "district = 'd1'", "district IS NULL", "district = 'd2' AND rental_day < '2024-01-04'", "district = 'none'"]

    def found(where):
        return store.distinct_counts(where).first()

    before = {w: found(w) for w in wheres}
    for where, got in before.items():
        rows = many.withColumn("rental_day", F.to_date("rental_date")).where(where or "true")
        want = M.distinct_counts(rows, COLUMNS).first() if not rows.isEmpty() else dict.fromkeys(COLUMNS, 0)
        assert got.rentals == rows.count()
        for c in COLUMNS:
            assert abs(got[c] - want[c]) <= 3 * D.relative_error() * want[c], (where, c, got[c], want[c])
    parts = store.table.read().count()
    store.merge()
    assert store.table.read().count() < parts
    for where, got in before.items():
        assert found(where).rentals == got.rentals
        for c in COLUMNS:
            assert abs(found(where)[c] - got[c]) <= D.relative_error() * got[c] + 1
    # a former version still stands for the first load alone
    assert store.distinct_counts(version=1).first().rentals == many.where(half).count()
    by = {r.district: r.rentals for r in store.distinct_counts(by=["district"]).collect()}
    assert by == {None: 10_000, "d1": 10_000, "d2": 10_000}


def test_sketches_take_the_policies(spark, many, tmp_path):
    store = D.DistinctStore(spark, str(tmp_path / "s"), ("station_id", "birth_year"))
    store.add(many)
    policies = P.standard_policies("d1")
    assert store.role_counts(policies, P.STEWARD).columns == ["rentals", "station_id", "birth_year"]
    district = store.role_counts(policies, P.DISTRICT_ANALYST)
    assert district.columns == ["rentals", "station_id"] and district.first().rentals == 10_000
    with pytest.raises(AnalysisException, match="birth_year"):
        store.role_counts(policies, P.MARKETING_PARTNER)
    with pytest.raises(PermissionError):
        store.role_counts(policies, "stranger")
    with pytest.raises(AnalysisException):
        store.distinct_counts("district IN (SELECT 'd1')")
    hidden = D.DistinctStore(spark, str(tmp_path / "h"), ("birth_year",))
    hidden.add(many)
    with pytest.raises(HiddenColumnError):
        hidden.role_counts(policies, P.DISTRICT_ANALYST)


def test_empty_store_and_null_columns(spark, many, tmp_path):
    store = D.DistinctStore(spark, str(tmp_path / "s"), ("station_id",))
    assert tuple(store.distinct_counts().first()) == (0, 0)
    store.add(many.limit(0))
    assert tuple(store.distinct_counts().first()) == (0, 0)
    store.add(many.limit(50).withColumn("station_id", F.lit(None).cast("string")))
    assert tuple(store.distinct_counts().first()) == (50, 1)
    with pytest.raises(ValueError, match="column"):
        D.DistinctStore(spark, str(tmp_path / "c"), COLUMNS, keys=("column",))
