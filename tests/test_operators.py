"""Operators on small rows: NULLs, junk, ties, boundaries, empty tables, skew."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from rows import rental, table, values

from rolelens.functions import scalar as S
from rolelens.operators import policy as P
from rolelens.operators import quality as Q
from rolelens.operators import segment as G
from rolelens.operators import share as H
from rolelens.operators import summary as M
from rolelens.plans import reports as R


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [
        rental(
            i,
            station_id=rng.choice(["s1", "s2", "s3", None]),
            usage_min=rng.choice([0, 1, 5, 9, 300, 600, None]),
            distance_meter=rng.choice([0, 5, 10.5, 1200.25, 31000, None]),
            birth_year=rng.choice(["1990.0", "x", "2006", "1950", "1900", None, "N", "1999"]),
            gender=rng.choice(["M", "F", None]),
            district=rng.choice(["A", "B", "C", None]),
            rental_date=rng.choice(
                [None, *[datetime.datetime(2024, 12, d, h) for d in (1, 2, 7) for h in (0, 8, 23)]]
            ),
        )
        for i in range(300)
    ]
    return table(spark, *rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(mixed):
    return mixed.limit(0)


def test_scalars_on_text(spark):
    df = spark.createDataFrame(
        [("1990.0", "bad"), ("2005", "2024-12-01 13:55:19"), (None, None), ("x", "")], "y string, t string"
    )
    got = df.select(
        S.age_group("y").alias("g"),
        S.hour_of_day("t").alias("h"),
        S.day_of_week("t").alias("d"),
        S.weekday_name("t").alias("w"),
        S.time_band("t").alias("b"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("30s", None, None, None, None),
        ("10s", 13, 1, "Sunday", "noon"),
        ("60s+", None, None, None, None),
        ("60s+", None, None, None, None),
    ]


def test_time_band_edges(spark):
    hours = spark.range(24).select(
        "id", F.expr("timestampadd(HOUR, cast(id AS int), timestamp_ntz'2024-01-01')").alias("t")
    )
    bands = dict(values(hours.select("id", S.time_band("t").alias("b")), "id", "b"))
    assert [bands[h] for h in (0, 5, 6, 7, 8, 9, 12, 14, 17, 19, 20, 23)] == (
        "dawn dawn other morning morning other noon other evening other night night".split()
    )


def test_outlier_boundaries(spark):
    df = table(
        spark,
        rental(1, usage_min=480, distance_meter=30000),
        rental(2, usage_min=1, distance_meter=10),
        rental(3, usage_min=-1, distance_meter=-5),
        rental(4, usage_min=5, distance_meter=None),
        rental(5, usage_min=0, distance_meter=50),
    )
    assert {r.rental_id for r in Q.outliers(df).collect()} == {"r3"}
    assert {r.rental_id for r in Q.outliers(df, Q.OPERATION_LIMITS).collect()} == {"r3", "r5"}
    assert values(Q.operational_outlier_top5(df), "rental_id") == [("r5",), ("r3",)]


def test_distinct_null_rules(mixed):
    one = M.distinct_counts(mixed, ["rental_id", "station_id", "district"]).first()
    assert (one.rental_id, one.station_id, one.district) == (300, 4, 4)
    approx = M.distinct_counts(mixed, ["station_id"], approx=True).first()
    assert approx.station_id == 4
    grouped = M.count_distinct_in_group(mixed, ["district"], "station_id")
    assert {r.distinct_values for r in grouped.collect()} == {3} and grouped.count() == 4


def test_empty_table(empty):
    assert M.distinct_counts(empty, ["district"]).first().district == 0
    assert M.distinct_counts(empty, ["district"], approx=True).first().district == 0
    one = M.quantile_profile(empty, "usage_min").first()
    assert (one.rentals, one.avg, one.min, one.p50) == (0, None, None, None)
    assert Q.outlier_summary(empty).first().outlier_pct is None
    kpi = M.kpis(empty).first()
    assert (kpi.rentals, kpi.station_turnover, kpi.service_coverage) == (0, None, None)
    assert H.district_share(empty).count() == 0
    stats = H.age_stats(empty, 2024).first()
    assert (stats.rentals, stats.avg_age, stats.stddev_age) == (0, None, None)
    assert all(v == 0 for v in Q.null_counts(empty).first())
    assert Q.sample_exact(empty, 5).count() == 0
    assert M.averages(empty, {"a": "usage_min"}).first().a is None


def test_ties_keep_the_lower_key(spark):
    df = table(spark, *[rental(i, station_id=f"s{i % 12:02}", station_name="x") for i in range(24)])
    assert [r.station_id for r in G.segment(df, "station_top10").collect()] == [
        f"s{i:02}" for i in range(10)
    ]


@pytest.mark.parametrize("column", ["usage_min", "distance_meter"])
@pytest.mark.parametrize("step", [1, 7, 100])
def test_quantiles_against_sorting(mixed, column, step):
    data = sorted(r[0] for r in mixed.select(column).collect() if r[0] is not None)
    quantiles = {"p1": 0.01, "p7": 0.07, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = M.numeric_summary(mixed, column, quantiles, step=step).first()
    for name, p in quantiles.items():
        rank = -(-Decimal(str(p)) * len(data) // 1)
        assert got[name] == data[int(rank) - 1], name
    assert (got.rentals, got.min, got.max) == (300, data[0], data[-1])
    assert got.avg == pytest.approx(float(sum(data)) / len(data))


def test_quantiles_beyond_the_bucket_edge(spark):
    df = spark.range(1001).select((F.col("id") * 10_000_000 - 4_000_000_000).alias("v"))
    got = M.numeric_summary(df, "v", {"low": 0.1, "mid": 0.5, "high": 0.9}).first()
    wanted = [r * 10_000_000 - 4_000_000_000 for r in (100, 500, 900)]
    assert [got.low, got.mid, got.high] == wanted


def test_quantiles_of_doubles_and_per_group(spark):
    df = spark.range(999).select(
        (F.col("id") % 4).alias("g"),
        F.when(F.col("id") % 4 != 3, (F.col("id") * 37 % 101) / 8 - 3).alias("v"),
    )
    rows = df.collect()
    got = M.numeric_summary(df, "v", keys={"g": F.col("g")}).collect()
    assert len(got) == 4
    for r in got:
        data = sorted(x.v for x in rows if x.g == r.g and x.v is not None)
        assert r.median == (data[-(-len(data) // 2) - 1] if data else None)


def test_quantiles_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    for data, p, want in (
        ([1.0, 2.0, 3.0, nan], 0.75, 3.0),
        ([5.0, 6.0, 7.0, nan], 0.25, 5.0),
        ([-inf, -1e308, 0.0, 1e308, inf], 0.6, 0.0),
        ([-inf, -1e308, 1e-300, 2e-300, 1e308], 0.8, 2e-300),
    ):
        df = spark.createDataFrame([(x,) for x in data], "v double")
        assert M.numeric_summary(df, "v", {"q": p}).first().q == want
    wide = spark.createDataFrame([(Decimal(10) ** 25 + i,) for i in range(5)], "v decimal(30,0)")
    assert M.numeric_summary(wide, "v").first().median == Decimal(10) ** 25 + 2


def test_quantiles_of_many_values_in_one_bucket(spark):
    """A million values below one: no bucket of any level holds more than its share of them."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n / F.lit(n * 1.25)).alias("v"))
    got = M.numeric_summary(df, "v", {"low": 0.1, "high": 0.9}).first()
    assert [round(x * n * 1.25) for x in (got.low, got.high)] == [n // 10 - 1, 9 * n // 10 - 1]


def test_quantiles_rise(mixed):
    q = M.quantile_profile(mixed, "distance_meter").first()
    assert q.min <= q.p25 <= q.p50 <= q.p75 <= q.p95 <= q.max
    approx = M.quantile_profile(mixed, "distance_meter", accuracy=100_000).first()
    assert approx == q


def test_group_counts_add_up(mixed):
    for name in ("district_stats", "gender_stats", "age_group_stats", "hourly_counts"):
        assert sum(r.rentals for r in G.segment(mixed, name).collect()) == 300


def test_shares_add_up(mixed):
    for shares in (H.gender_share(mixed), H.age_share(mixed), H.district_share(mixed)):
        assert sum(r.pct for r in shares.collect()) == pytest.approx(100, abs=0.05)
    within = H.district_age_share(mixed, top=2).collect()
    assert len({r.district for r in within}) == 2
    for d in {r.district for r in within}:
        assert sum(r.pct for r in within if r.district == d) == pytest.approx(100, abs=0.05)


def test_lift_of_one_group_is_one(mixed):
    one = H.segment_lift(mixed.where("district = 'A'"), F.col("gender"), name="gender")
    assert {r.lift for r in one.collect()} == {1.0} and one.count() == 3


@pytest.mark.parametrize("role", sorted(R.REPORTS))
def test_fused_sections_equal_single_reports(mixed, role):
    scoped = P.policy_view(mixed, P.standard_policies("A"), role)
    report = R.role_report(scoped, role)
    parts = R.REPORTS[role]
    assert set(report) == {*parts.segments, *parts.scalars, *parts.tables}
    assert report["row_count"].collect() == M.row_count(scoped).collect()
    if "null_counts" in report:
        assert report["null_counts"].collect() == Q.null_counts(scoped).collect()
    if "outlier_summary" in report:
        limits = Q.OPERATION_LIMITS if role == P.OPERATION else Q.STEWARD_LIMITS
        assert report["outlier_summary"].collect() == Q.outlier_summary(scoped, limits).collect()
    for name in R.REPORTS[role].segments:
        assert report[name].collect() == G.segment(scoped, name).collect(), name
    for name in R.REPORTS[role].tables:
        assert report[name].columns and report[name].collect() is not None


def test_show_report(mixed, capsys):
    R.show_report({"gender_stats": G.segment(mixed, "gender_stats")}, rows=2)
    assert "== gender_stats" in capsys.readouterr().out


def test_dedupe_and_duplicates(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q"), (None, 3, "n"), (None, 3, "n")],
        "k string, o int, v string",
    )
    got = sorted(values(Q.dedupe(df, ["k"], ["o"]), "k", "o", "v"), key=str)
    assert got == sorted([("a", 1, "y"), ("b", None, "q"), (None, 3, "n")], key=str)
    assert Q.dedupe(df, ["k", "o", "v"]).count() == 5
    assert sorted(values(Q.duplicate_keys(df, ["k"]), "k", "copies"), key=str) == [("a", 3), (None, 2)]


def test_sample_exact_with_a_hot_key(spark):
    df = spark.range(900).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS k", "id % 7 AS a", "id AS b"
    )
    hashes = sorted(
        values(df.select(F.md5("k").alias("h"), "k"), "h", "k"), key=lambda r: r[0]
    )
    first_hot = next(i for i, r in enumerate(hashes) if r[1] == "hot")
    everything = set(values(df, "k", "a", "b"))
    for n in (1, first_hot, first_hot + 100, first_hot + 300, 899, 900, 1000):
        got = values(Q.sample_exact(df, n, "k"), "k", "a", "b")
        assert len(got) == min(n, 900) and set(got) <= everything
        assert {r[0] for r in got} == {k for _, k in hashes[:n]}
    again = Q.sample_exact(df.repartition(7), first_hot + 100, "k")
    assert set(values(again, "b")) == set(values(Q.sample_exact(df, first_hot + 100, "k"), "b"))


def test_sample_exact_with_identical_rows(spark):
    df = spark.range(100).selectExpr("'same' AS k", "1 AS v")
    assert values(Q.sample_exact(df, 42, "k"), "k", "v") == [("same", 1)] * 42
    Q.PORTION, portion = 10, Q.PORTION
    try:
        assert values(Q.sample_exact(df, 42, "k"), "k", "v") == [("same", 1)] * 42
    finally:
        Q.PORTION = portion


def test_sample_fraction(spark):
    df = spark.range(4000).selectExpr("cast(id AS string) AS rental_id")
    picked = Q.sample_fraction(df, 0.25)
    assert 850 < picked.count() < 1150
    assert set(picked.collect()) == set(Q.sample_fraction(df.repartition(5), 0.25).collect())
    assert Q.sample_fraction(df, 1.0).count() == 4000 and Q.sample_fraction(df, 0.0).count() == 0
    assert 800 < Q.sample_fraction(df, 0.25, seed=1).count() < 1200
    with pytest.raises(ValueError):
        Q.sample_fraction(df, 1.5)


def test_small_fractions_of_large_tables(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("rental_id"))
    assert 2 <= Q.sample_fraction(df, 1e-5).count() <= 25
    assert 5 <= Q.sample_fraction(df, 2e-5).count() <= 40


def test_samples_keep_rows_without_key(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "rental_id string, v int")
    assert Q.sample_fraction(df, 1.0).count() == 3
    assert Q.sample_exact(df, 5).count() == 3 and Q.sample_exact(df, 2).count() == 2


def test_exact_sample_tells_microseconds_apart(spark):
    df = spark.range(50).select(
        F.lit("k").alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("at")
    )
    first = set(values(Q.sample_exact(df, 20, "k"), "at"))
    assert len(first) == 20 and first == set(values(Q.sample_exact(df.repartition(5), 20, "k"), "at"))


def test_one_reading_of_birth_years(spark):
    df = table(spark, *[rental(i, birth_year=y) for i, y in enumerate(("2010.5", "1939.9", "2011", "1950", "x"))])
    outside = {r.column: r.out_of_range for r in Q.missing_profile(df).collect()}["birth_year"]
    assert Q.valid_age(df).count() == 2 and outside == 3


def test_quality_filters(spark):
    raw = spark.createDataFrame(
        [("a", "bad", "2024-01-01 00:00:00"), ("b", None, "2024-01-01 00:00:00"),
         ("c", "2024-01-02 00:00:00", "2024-01-01 00:00:00"), ("d", "2024-01-01", "2024-01-01 00:00:00")],
        "id string, rental_date string, return_date string",
    )
    assert values(Q.invalid_dates(raw), "id") == [("a",)]
    assert values(Q.negative_duration(raw), "id") == [("c",)]
    years = table(spark, *[rental(i, birth_year=y) for i, y in enumerate(["1940", "2010", "1939", "2011", "N", None, "1990.0"])])
    assert [r.rental_id for r in Q.valid_age(years).collect()] == ["r0", "r1", "r6"]
    assert Q.sentinel_filter(years).count() == 6
    profile = {r.column: r for r in Q.missing_profile(years).collect()}
    assert tuple(profile["birth_year"])[1:5] == (1, 1, 3, 4)
    assert profile["gender"].missing == 0


def test_age_stats(spark):
    df = table(spark, *[rental(i, birth_year=y) for i, y in enumerate(["1990", "1994", "2000", "x"])])
    got = H.age_stats(df, 2024).first()
    assert (got.rentals, got.min_age, got.max_age, got.median_age) == (3, 24, 34, 30.0)
    assert got.stddev_age == pytest.approx(5.033223, abs=1e-6)
    top = H.top_birth_years(df, 2024, 1).first()
    assert (top.birth_year, top.age, top.rentals) == (1990, 34, 1)


def test_kpis(spark):
    df = table(
        spark,
        rental(1, station_id="a", usage_min=0, distance_meter=100),
        rental(2, station_id="a", usage_min=10, distance_meter=100),
        rental(3, station_id=None, usage_min=0, distance_meter=50),
        rental(4, station_id="b", usage_min=None, distance_meter=50),
    )
    got = M.kpis(df).first()
    assert (got.stations, got.active_stations) == (3, 1)
    assert got.station_turnover == pytest.approx(4 / 3)
    assert got.avg_efficiency == 10.0 and got.service_coverage == 33.3333
