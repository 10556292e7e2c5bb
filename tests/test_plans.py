"""Plans: what reaches the scan, what is shared, what is dropped."""

import re

import pytest
from pyspark.sql import functions as F
from rows import rental, table

from rolelens.catalog.queries import DISTRICT
from rolelens.functions import scalar as S
from rolelens.operators import policy as P
from rolelens.operators import quality as Q
from rolelens.operators import segment as G
from rolelens.operators import share as H
from rolelens.operators import summary as M
from rolelens.plans import reports as R
from rolelens.sources.load import csv_scan, load
from rolelens.sources.rentals import rentals

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The adaptive plan as it ran, without the initial plan printed after it."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    rows = [rental(i, district="ABCD"[i % 4], usage_min=i % 9) for i in range(80)]
    table(spark, *rows).write.option("header", True).csv(str(root / "csv"))
    out = load(spark, str(root / "csv"), str(root / "table"))
    assert csv_scan(spark, str(root / "csv")).count() == out.count() == 80
    return out


def test_row_filter_and_columns_reach_the_scan(stored):
    scoped = P.policy_view(stored, P.standard_policies("A"), P.MARKETING_PARTNER)
    text = plan(G.segment(scoped, "hourly_usage"))
    scan = next(line for line in text.split("\n") if "FileScan" in line)
    assert "EqualTo(district,A)" in scan and "GreaterThanOrEqual(birth_year,1994)" in scan
    schema = scan.split("ReadSchema: ")[1]
    assert schema.count(":") == 4 and "station" not in schema  # date, minutes, and the predicate's


def test_rows_of_a_district_lie_together(stored):
    districts = [r.district for r in stored.select("district").collect()]
    files = len(stored.inputFiles())
    changes = sum(a != b for a, b in zip(districts, districts[1:]))
    assert changes < 4 * files


def test_unused_dimensions_are_not_joined(spark):
    assert "Join" not in plan(G.segment(rentals(spark, SF_DIR), "hourly_load"))
    assert "Join" in plan(G.segment(rentals(spark, SF_DIR), "district_stats"))


def test_district_role_gets_inner_joins(spark):
    scoped = P.policy_view(rentals(spark, SF_DIR), P.standard_policies(DISTRICT), P.DISTRICT_ANALYST)
    text = plan(G.segment(scoped, "hourly_counts"))
    assert "LeftOuter" not in text and "Inner" in text


def reads(spark, df, build):
    """How often the rows of ``df`` are read to build and collect a result."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    build(df.where(seen.asNondeterministic()(F.monotonically_increasing_id()))).collect()
    return read.value / df.count()


@pytest.mark.parametrize(
    ("most", "build"),
    [
        (1, lambda t: M.quantile_profile(t, "usage_min")),
        (2, lambda t: M.quantile_profile(t, "distance_meter")),
        (1, H.age_group_usage),
        (2, H.age_group_distance),
        (1, H.district_age_share),
    ],
)
def test_table_reads(spark, stored, most, build):
    assert 0 < reads(spark, stored, build) <= most


def test_a_hot_user_is_dealt_out(spark, tmp_path):
    n = 20_000
    spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id") % 1000).alias("user_id"),
        F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(1000).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('N', id) AS n_name").write.parquet(
        str(tmp_path / "nation.parquet")
    )
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
            "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = rentals(spark, str(tmp_path)).where("district IS NOT NULL").select("station_id", "district")
        text = plan(joined)
        assert "SortMergeJoin" in text
        # the shuffle under the first join deals by user and salt
        assert re.search(r"hashpartitioning\(user_id#\d+L?, pmod\(hash\(event_id", text)
        assert joined.where("station_id = '7'").count() >= 0.8 * n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("role", sorted(R.REPORTS))
def test_reports_read_the_table_three_times_at_most(spark, stored, role):
    policies = P.standard_policies("A")
    assert 0 < reads(spark, P.policy_view(stored, policies, role), lambda t: R.report_long(t, role)) <= 3


def test_share_reuses_the_grouped_counts(stored):
    assert "ReusedExchange" in ran(H.gender_share(stored))


def test_top_k_does_not_sort_all_groups(stored):
    text = plan(G.segment(stored, "station_top10"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_no_cross_joins(stored):
    for df in (
        H.segment_lift(stored, S.age_group()),
        H.district_age_share(stored),
        Q.sample_exact(stored, 7),
        M.quantile_profile(stored, "distance_meter"),
        M.distinct_counts(stored, ["rental_id", "district"]),
    ):
        df.collect()
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text
