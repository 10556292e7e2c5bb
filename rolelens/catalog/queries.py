"""Every registered query: name -> callable(spark, sf_dir) -> DataFrame.

Results use portable types (doubles for decimals, text for timestamps and arrays) so that another
SQL engine can be compared with them value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.operators import audit as A
from rolelens.operators import filters
from rolelens.operators import policy as P
from rolelens.operators import quality as Q
from rolelens.operators import segment as G
from rolelens.operators import share as H
from rolelens.operators import sketches as D
from rolelens.operators import summary as M
from rolelens.operators.heavy import heavy_segment
from rolelens.operators.stored import StoredRegistry
from rolelens.plans import reports as R
from rolelens.schema import PERSONAL_COLUMNS, POLICY_SCHEMA, RENTAL_COLUMNS, RENTAL_SCHEMA
from rolelens.session import work_path
from rolelens.sources import load as L
from rolelens.sources.layout import write_clustered
from rolelens.sources.logs import log_metrics
from rolelens.sources.rentals import read_table, rentals
from rolelens.sources.versions import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]

DISTRICT = "NATION_20"  # the district of the two row-filtered roles
AS_OF_YEAR = 2024
SAMPLE_FRACTION = 0.156  # 100,000 of 641,228 rows
SAMPLE_ROWS = 500


def portable(df: DataFrame) -> DataFrame:
    def cast(field: T.StructField) -> str:
        name, kind = f"`{field.name}`", field.dataType
        if isinstance(kind, T.DecimalType):
            return f"cast({name} AS double) AS {name}"
        if isinstance(kind, T.TimestampNTZType):
            return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {name}"
        if isinstance(kind, T.IntegerType):
            return f"cast({name} AS bigint) AS {name}"
        if isinstance(kind, T.ArrayType):
            return f"array_join({name}, ',') AS {name}"
        return name

    return df.selectExpr(*[cast(f) for f in df.schema])


# --- inputs --------------------------------------------------------------------------------------


def scoped(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return P.policy_view(rentals(spark, sf_dir), P.standard_policies(DISTRICT), role)


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy registry read off the data: one analyst per district, one operator per station,
    and the four standard roles. Stored as a table, as registries are, since queries use it often."""
    return indexed_policies(spark, sf_dir).select(*POLICY_SCHEMA.names)


def indexed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same registry with what is known of each filter, stored when the policies are made."""
    table = rentals(spark, sf_dir)
    no_birth_year = F.array(*[F.lit(c) for c in RENTAL_COLUMNS if c != "birth_year"])
    personal = F.array(*[F.lit(c) for c in PERSONAL_COLUMNS])

    def per_value(column: str, role: str, include, exclude) -> DataFrame:
        value = F.col(column)
        return (
            table.where(value.isNotNull())
            .select(column)
            .distinct()
            .select(
                F.concat(F.lit(f"{role}_"), value).alias("role"),
                F.concat(F.lit(f"{column}_filter_"), value).alias("name"),
                F.lit(P.TABLE).alias("table"),
                P.equals_filters(column, value).alias("row_filter"),
                F.lit(False).alias("all_rows"),
                include.cast("array<string>").alias("include_columns"),
                exclude.cast("array<string>").alias("exclude_columns"),
                *[c.alias(n) for n, c in P.equals_index(column, value).items()],
            )
        )

    nothing = F.lit(None)
    derived = per_value("district", "analyst", no_birth_year, nothing).unionByName(
        per_value("station_id", "operator", nothing, personal)
    )
    path = work_path(spark, "policies")
    standard = filters.indexed(P.policy_registry(spark, P.standard_policies(DISTRICT)))
    derived.unionByName(standard).write.parquet(path)
    return spark.read.schema(T.StructType([*POLICY_SCHEMA, *filters.INDEX_SCHEMA])).parquet(path)


def _tightened(registry: DataFrame) -> DataFrame:
    """New versions of the district filters, which also hide gender."""
    return registry.where(F.col("name").startswith("district_filter_")).withColumn(
        "include_columns", F.array_remove("include_columns", "gender")
    )


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """The rentals as CSV text with three further columns, some rows without a station.

    Returns the folder, written by Spark in the shared work folder.
    """
    path = work_path(spark, "rentals_csv")
    table = rentals(spark, sf_dir)
    text = [F.col(c).cast("string").alias(c) for c in RENTAL_COLUMNS]
    extra = [
        F.col(c).cast("string").alias(f"{c}_numeric")
        for c in ("usage_min", "distance_meter", "birth_year")
    ]
    row = table.select(*text, *extra)
    no_station = F.substring(F.md5("rental_id"), 1, 2) == "00"
    row.withColumn("station_id", F.when(~no_station, F.col("station_id"))).write.option(
        "header", True
    ).csv(path)
    return path


def _stored(spark: SparkSession, sf_dir: str, name: str, replace: bool = False, twice: bool = False) -> DataFrame:
    """A catalog table filled from the CSV.

    Its name is new in each run, and it leaves the catalog here; the result reads its files.
    """
    source = L.csv_scan(spark, _csv(spark, sf_dir))
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    path = work_path(spark, name)
    L.replace_table(spark, name, path)
    if replace:
        L.load_insert(source, name)
        L.replace_table(spark, name, path)
    for _ in range(2 if twice else 1):
        stored = L.load_insert(source, name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """One job log per district, with the row count of that district and its schema block."""
    table = rentals(spark, sf_dir)
    columns = [c for c in RENTAL_COLUMNS if c != "birth_year"]
    block = "root\n" + "".join(f" |-- {c}: string (nullable = true)\n" for c in columns)
    path = work_path(spark, "logs")
    (
        table.where(F.col("district").isNotNull())
        .groupBy(F.col("district").alias("role"))
        .agg(F.count("*").alias("n"))
        .select(
            "role",
            F.concat(
                F.lit("start\n✅ 필터링 후 레코드 수: "),
                F.format_number("n", 0),
                F.lit("건\n" + block + "\n|-- after the block\n"),
            ).alias("value"),
        )
        .write.partitionBy("role")
        .text(path)
    )
    return path


def _log_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The districts, and a role without a log."""
    districts = rentals(spark, sf_dir).where("district IS NOT NULL").select(F.col("district").alias("role"))
    return districts.unionByName(spark.range(1).select(F.lit("nobody").alias("role")))


# --- queries -----------------------------------------------------------------------------------


def _on(build: Callable[[DataFrame], DataFrame], role: str | None = None) -> Query:
    """A query over the whole table, or over the part one role sees."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = rentals(spark, sf_dir) if role is None else scoped(spark, sf_dir, role)
        return portable(build(table))

    return run


def _registry(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(build(policy_table(spark, sf_dir)))


def _indexed(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(build(indexed_policies(spark, sf_dir)))


def _policies() -> list[P.Policy]:
    return P.standard_policies(DISTRICT)


def _column(name: str, build: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda t: t.select("rental_id", build().alias(name))


def load_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(spark, sf_dir)
    stored = L.load(spark, path, work_path(spark, "stored"))
    return portable(L.load_reconcile(L.csv_scan(spark, path), stored))


def load_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, the same again, and a second one in its place."""
    source, path = _csv(spark, sf_dir), work_path(spark, "versions")
    for load_id in ("first", "first"):
        L.load_staged(spark, source, path, load_id)
    table = L.load_staged(spark, source, path, "second", replace=True)
    L.load_staged(spark, source, path, "third")
    return portable(table.read(2).unionByName(table.read(1)))


def clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district role's rows, read from a table in the order of districts."""
    table = write_clustered(rentals(spark, sf_dir), work_path(spark, "clustered"))
    return portable(P.policy_view(table, P.standard_policies(DISTRICT), P.DISTRICT_ANALYST))


def merge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rental after two loads that overlap: the one with the shortest use."""
    table = rentals(spark, sf_dir)
    digit = F.substring("rental_id", -1, 1)
    longer = F.when(digit.isin("1", "3", "5", "7", "9"), 2).otherwise(0)
    first = table.where(digit <= "4").withColumn("usage_min", F.col("usage_min") + 1)
    second = table.where(digit >= "3").withColumn("usage_min", F.col("usage_min") + longer)
    stored = VersionedTable(spark, work_path(spark, "merged"), RENTAL_SCHEMA)
    for load_id, rows in (("first", first), ("second", second), ("first", first)):
        stored.merge_distinct(rows, ("rental_id",), ("usage_min",), load_id)
    return portable(stored.read())


def content_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on both sides, over all key ranges, and whether each range is equal."""
    path = _csv(spark, sf_dir)
    stored = L.load(spark, path, work_path(spark, "stored"))
    ranges = L.content_reconcile(L.csv_scan(spark, path), stored)
    return ranges.agg(
        F.sum("source_rows").alias("source_rows"),
        F.sum("loaded_rows").alias("loaded_rows"),
        F.count_if(~F.col("ok")).alias("differing_ranges"),
    )


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after changes by commits: all policies, tightened ones, one dropped, then compacted."""
    registry = StoredRegistry(spark, work_path(spark, "registry"))
    policies = indexed_policies(spark, sf_dir)
    registry.upsert(policies)
    registry.upsert(_tightened(policies))
    registry.drop(P.TABLE, f"district_filter_{DISTRICT}")
    registry.compact()
    return portable(registry.policies().select(*POLICY_SCHEMA.names))


def grant_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants after a repeated grant and a revocation, by commits."""
    registry = StoredRegistry(spark, work_path(spark, "registry"))
    grants = _grants(policy_table(spark, sf_dir))
    registry.grant(grants)
    registry.grant(grants)
    registry.revoke(grants.where("resource_type = 'FILTER' AND role LIKE 'analyst%'"))
    return portable(registry.grants())


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return portable(Q.duplicate_keys(lines, ("l_orderkey", "l_linenumber")))


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    keys, order = ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_partkey")
    return portable(Q.dedupe(lines, keys, order))


def sentinel_filter(t: DataFrame) -> DataFrame:
    return Q.sentinel_filter(t).select("rental_id", "birth_year")


def invalid_dates(t: DataFrame) -> DataFrame:
    """Texts with the hour cut off for some rows, so that they do not parse."""
    broken = F.substring(F.md5("rental_id"), 1, 1) == "0"
    text = F.date_format("rental_date", "yyyy-MM-dd HH:mm:ss")
    raw = t.select(
        "rental_id",
        F.when(broken, F.concat(F.lit("x"), text)).otherwise(text).alias("rental_date"),
        F.col("return_date").cast("string").alias("return_date"),
    )
    return Q.invalid_dates(raw).select("rental_id", "rental_date")


def negative_duration(t: DataFrame) -> DataFrame:
    """Dates swapped for the rows of one user type, so that some rentals end before they start."""
    swap = F.col("user_type") == "new"
    moved = t.select(
        "rental_id",
        F.when(swap, F.col("return_date")).otherwise(F.col("rental_date")).alias("rental_date"),
        F.when(swap, F.col("rental_date")).otherwise(F.col("return_date")).alias("return_date"),
    )
    return Q.negative_duration(moved)


# --- results that depend on the engine: does the promised bound hold? ---


def distinct_counts_approx(t: DataFrame) -> DataFrame:
    """Per column: the estimate lies within three standard deviations of the exact count."""
    rsd = 0.05
    both = M.distinct_counts(t, R.ID_COLUMNS, approx=True, rsd=rsd).unionByName(
        M.distinct_counts(t, R.ID_COLUMNS)
    )
    close = [
        (F.max(c) - F.min(c) <= F.lit(3 * rsd) * F.greatest(F.max(c), F.lit(1))).alias(c) for c in R.ID_COLUMNS
    ]
    return both.agg(*close)


def distance_quantiles_approx(t: DataFrame) -> DataFrame:
    """Per quantile: the rank of the estimate is off by at most 1 / accuracy of the rows."""
    accuracy = 1000
    found = M.quantile_profile(t, "distance_meter", accuracy=accuracy).first()  # one row
    value, n = F.col("distance_meter"), F.count("distance_meter")
    near = [
        (
            (F.count_if(value < found[q]) <= (p + 1 / accuracy) * n + 1)
            & (F.count_if(value <= found[q]) >= (p - 1 / accuracy) * n - 1)
        ).alias(q)
        for q, p in M.QUARTILES.items()
    ]
    return t.agg(*near)


def distinct_sketches_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role, from stored sketches of two loads: its rows, and whether each estimate lies within three
    standard deviations of the exact count. The marketing filter needs sketches by birth year too."""
    table = rentals(spark, sf_dir)
    late = F.substring("rental_id", -1, 1) >= "5"
    stores = {}
    for keys in (("district", D.DAY), ("district", "birth_year")):
        store = D.DistinctStore(spark, work_path(spark, "sketches"), R.ID_COLUMNS, keys)
        for load_id, rows in (("first", table.where(~late)), ("second", table.where(late)), ("first", table)):
            store.add(rows, load_id)
        store.merge()
        stores[keys] = store
    bound = 3 * D.relative_error()
    both = []
    for policy in _policies():
        keys = ("district", "birth_year") if policy.role == P.MARKETING_PARTNER else ("district", D.DAY)
        seen = M.distinct_counts(P.policy_view(table, _policies(), policy.role), R.ID_COLUMNS)
        both += [
            counts.withColumn("role", F.lit(policy.role))
            for counts in (
                stores[keys].role_counts(_policies(), policy.role).withColumn("exact", F.lit(False)),
                seen.withColumns({"exact": F.lit(True), "rentals": F.lit(None).cast("long")}),
            )
        ]
    close = [
        (F.max(c) - F.min(c) <= F.lit(bound) * F.max(F.when(F.col("exact"), F.col(c)))).alias(c) for c in R.ID_COLUMNS
    ]
    return portable(reduce(DataFrame.unionByName, both).groupBy("role").agg(F.max("rentals").alias("rentals"), *close))


def sample_fraction_random(t: DataFrame) -> DataFrame:
    """The sampled share lies within five standard deviations, and only rows of the table are drawn."""
    drawn = Q.sample_fraction(t, SAMPLE_FRACTION, seed=7).select("rental_id").distinct()
    joined = t.select("rental_id").join(drawn.withColumn("drawn", F.lit(1)), "rental_id", "full")
    n, k = F.count("*"), F.count("drawn")
    deviation = (SAMPLE_FRACTION * (1 - SAMPLE_FRACTION)) ** 0.5
    return joined.agg(
        n.alias("rentals"),
        (F.abs(k - SAMPLE_FRACTION * n) <= 5 * deviation * F.sqrt(n)).alias("share_as_asked"),
        (k <= n).alias("rows_of_the_table"),
    )


def _grants(registry: DataFrame) -> DataFrame:
    return P.role_grants(registry)


def _granted_twice(registry: DataFrame) -> DataFrame:
    grants = _grants(registry)
    return P.grant(grants, grants)


def _revoked(registry: DataFrame) -> DataFrame:
    grants = P.grant(_grants(registry), _grants(registry))
    return P.revoke(grants, grants.where("resource_type = 'FILTER' AND role LIKE 'analyst%'"))


def _denied(registry: DataFrame) -> DataFrame:
    """One filter dropped and the analysts' filter grants revoked: who can no longer read."""
    left = P.policy_drop(registry, P.TABLE, "operation_filter")
    return P.denied_roles(registry, left, _revoked(registry))


def _role_report(role: str) -> Query:
    return _on(lambda t: R.report_long(t, role), role)


QUERIES: dict[str, Query] = {
    # sources, sinks, tables
    "csv_scan": lambda s, d: portable(L.normalise(L.csv_scan(s, _csv(s, d)))),
    "table_scan": lambda s, d: portable(L.table_scan(s, f"{d}/events.parquet")),
    "create_table": lambda s, d: portable(_stored(s, d, "rentals_created")),
    "replace_table": lambda s, d: portable(_stored(s, d, "rentals_replaced", replace=True)),
    "load_insert": lambda s, d: portable(_stored(s, d, "rentals_inserted", twice=True)),
    "load_reconcile": load_reconcile,
    "load_staged": load_staged,
    "clustered_scan": clustered_scan,
    "merge_distinct": merge_distinct,
    "content_reconcile": content_reconcile,
    "schema_report": lambda s, d: portable(L.schema_report(_stored(s, d, "rentals_described"))),
    "preview": _on(L.preview),
    "log_metrics": lambda s, d: portable(
        log_metrics(s, _logs(s, d), _log_roles(s, d)).drop("path")
    ),
    # policies and grants
    "row_filter": _on(lambda t: P.row_filter(t, _policies()[1])),
    "all_rows": _on(lambda t: P.row_filter(t, _policies()[0])),
    "column_include": _on(lambda t: P.column_include(t, _policies()[2].include_columns)),
    "column_exclude": _on(lambda t: P.column_exclude(t, PERSONAL_COLUMNS)),
    "policy_view": _on(lambda t: t, P.MARKETING_PARTNER),
    "policy_upsert": _registry(lambda r: P.policy_upsert(r, _tightened(r))),
    "policy_drop": _registry(
        lambda r: P.policy_drop(r, P.TABLE, f"district_filter_{DISTRICT}").drop("all_rows")
    ),
    "policy_log": policy_log,
    "grant_log": grant_log,
    "policy_list": _registry(lambda r: P.policy_list(r, P.TABLE)),
    "policy_count": _registry(lambda r: P.policy_count(r, P.TABLE)),
    "grant": _registry(_granted_twice),
    "revoke": _registry(_revoked),
    "grant_list": _registry(lambda r: P.grant_list(_revoked(r))),
    "default_deny": _registry(_denied),
    "role_report_steward": _role_report(P.STEWARD),
    "role_report_district": _role_report(P.DISTRICT_ANALYST),
    "role_report_operation": _role_report(P.OPERATION),
    "role_report_marketing": _role_report(P.MARKETING_PARTNER),
    # counts
    "row_count": _on(M.row_count),
    "distinct_counts": _on(lambda t: M.distinct_counts(t, R.ID_COLUMNS)),
    "distinct_counts_scoped": _on(
        lambda t: M.distinct_counts(t, R.ID_COLUMNS), P.MARKETING_PARTNER
    ),
    "distinct_counts_approx": _on(distinct_counts_approx),
    "distinct_sketches_roles": distinct_sketches_roles,
    "count_distinct_in_group": _on(
        lambda t: M.count_distinct_in_group(t, ["user_type"], "district")
    ),
    # grouped reports, on the table of the role that runs them
    "district_top10": _on(lambda t: G.segment(t, "district_top10"), P.STEWARD),
    "district_stats": _on(lambda t: G.segment(t, "district_stats"), P.DISTRICT_ANALYST),
    "district_operations": _on(lambda t: G.segment(t, "district_operations"), P.OPERATION),
    "gender_stats": _on(lambda t: G.segment(t, "gender_stats"), P.STEWARD),
    "gender_stats_distance": _on(
        lambda t: G.segment(t, "gender_stats_distance"), P.MARKETING_PARTNER
    ),
    "age_group_stats": _on(lambda t: G.segment(t, "age_group_stats"), P.STEWARD),
    "station_top10": _on(lambda t: G.segment(t, "station_top10"), P.DISTRICT_ANALYST),
    "station_popular": _on(lambda t: G.segment(t, "station_popular"), P.MARKETING_PARTNER),
    "station_efficiency": _on(lambda t: G.segment(t, "station_efficiency"), P.OPERATION),
    "station_top10_heavy": _on(lambda t: heavy_segment(t, "station_top10"), P.DISTRICT_ANALYST),
    "station_popular_heavy": _on(lambda t: heavy_segment(t, "station_popular"), P.MARKETING_PARTNER),
    "hourly_counts": _on(lambda t: G.segment(t, "hourly_counts"), P.STEWARD),
    "hourly_usage": _on(lambda t: G.segment(t, "hourly_usage"), P.MARKETING_PARTNER),
    "hourly_load": _on(lambda t: G.segment(t, "hourly_load"), P.OPERATION),
    "weekday_operations": _on(lambda t: G.segment(t, "weekday_operations"), P.OPERATION),
    "weekday_pattern": _on(lambda t: G.segment(t, "weekday_pattern"), P.MARKETING_PARTNER),
    "user_type_stats": _on(lambda t: G.segment(t, "user_type_stats"), P.DISTRICT_ANALYST),
    "user_type_operations": _on(lambda t: G.segment(t, "user_type_operations"), P.OPERATION),
    "peak_hour": _on(lambda t: G.segment(t, "peak_hour"), P.MARKETING_PARTNER),
    # summaries and quantiles
    "usage_summary": _on(lambda t: M.numeric_summary(t, "usage_min")),
    "distance_summary": _on(lambda t: M.numeric_summary(t, "distance_meter")),
    "usage_quantiles": _on(lambda t: M.quantile_profile(t, "usage_min"), P.OPERATION),
    "distance_quantiles": _on(lambda t: M.quantile_profile(t, "distance_meter"), P.OPERATION),
    "distance_quantiles_approx": _on(distance_quantiles_approx, P.OPERATION),
    "avg_usage": _on(lambda t: M.averages(t, {"avg_usage": "usage_min"}), P.MARKETING_PARTNER),
    "avg_distance": _on(
        lambda t: M.averages(t, {"avg_distance": "distance_meter"}), P.MARKETING_PARTNER
    ),
    # operating ratios
    "station_turnover": _on(lambda t: M.kpis(t).select("station_turnover"), P.OPERATION),
    "avg_efficiency": _on(lambda t: M.kpis(t).select("avg_efficiency"), P.OPERATION),
    "service_coverage": _on(lambda t: M.kpis(t).select("service_coverage"), P.OPERATION),
    "kpis": _on(M.kpis, P.OPERATION),
    # predicates and expressions
    "outliers": _on(Q.outliers, P.STEWARD),
    "outlier_summary": _on(Q.outlier_summary, P.STEWARD),
    "outlier_sample": _on(Q.outlier_sample, P.STEWARD),
    "operational_outliers": _on(lambda t: Q.outliers(t, Q.OPERATION_LIMITS), P.OPERATION),
    "operational_outlier_summary": _on(
        lambda t: Q.outlier_summary(t, Q.OPERATION_LIMITS), P.OPERATION
    ),
    "operational_outlier_top5": _on(Q.operational_outlier_top5, P.OPERATION),
    "age_group": _on(_column("age_group", S.age_group)),
    "hour_of_day": _on(_column("hour", S.hour_of_day)),
    "weekday_name": _on(_column("weekday", S.weekday_name)),
    "day_of_week": _on(_column("day_of_week", S.day_of_week)),
    "active_filter": _on(lambda t: Q.active_filter(t).select("rental_id", "usage_min")),
    "not_null_keys": _on(
        lambda t: Q.not_null_keys(t, ("birth_year", "gender", "district")).select("rental_id")
    ),
    # quality and preparation
    "null_counts": _on(Q.null_counts),
    "null_counts_scoped": _on(Q.null_counts, P.DISTRICT_ANALYST),
    "missing_profile": _on(Q.missing_profile),
    "sentinel_filter": _on(sentinel_filter),
    "sample_fraction": _on(lambda t: Q.sample_fraction(t, SAMPLE_FRACTION).select("rental_id")),
    "sample_fraction_random": _on(sample_fraction_random),
    "sample_exact": _on(lambda t: Q.sample_exact(t, SAMPLE_ROWS)),
    "duplicate_keys": duplicate_keys,
    "dedupe": dedupe,
    "invalid_dates": _on(invalid_dates),
    "negative_duration": _on(negative_duration),
    "valid_age": _on(lambda t: Q.valid_age(t).select("rental_id", "birth_year")),
    "numeric_casts": _on(
        lambda t: Q.numeric_casts(t).select(
            "rental_id", "usage_min_numeric", "distance_numeric", "birth_year_numeric"
        )
    ),
    # documented analyses
    "district_age": _on(lambda t: G.district_age(t, AS_OF_YEAR), P.STEWARD),
    "station_gender": _on(lambda t: G.segment(t, "station_gender"), P.DISTRICT_ANALYST),
    "district_station_hour": _on(lambda t: G.segment(t, "district_station_hour"), P.OPERATION),
    "district_station_hour_heavy": _on(lambda t: heavy_segment(t, "district_station_hour"), P.OPERATION),
    "station_gender_day": _on(
        lambda t: G.segment(t, "station_gender_day"), P.MARKETING_PARTNER
    ),
    "district_share": _on(H.district_share),
    "gender_share": _on(H.gender_share),
    "user_type_share": _on(H.user_type_share),
    "age_share": _on(H.age_share),
    "district_age_share": _on(H.district_age_share),
    "dominant_age": _on(H.dominant_age),
    "segment_lift": _on(lambda t: H.segment_lift(Q.valid_age(t), S.age_group())),
    "gender_age_crosstab": _on(H.gender_age_crosstab),
    "age_stats": _on(lambda t: H.age_stats(t, AS_OF_YEAR)),
    "top_birth_years": _on(lambda t: H.top_birth_years(t, AS_OF_YEAR)),
    "age_group_usage": _on(H.age_group_usage),
    "age_group_distance": _on(H.age_group_distance),
    "time_band": _on(lambda t: G.segment(t, "time_band")),
    # access audit
    "access_audit": _on(lambda t: A.access_audit(t, _policies())),
    "access_ratio": _on(lambda t: A.access_ratio(A.access_audit(t, _policies()))),
    "districts_per_role": _on(lambda t: A.districts_per_role(t, _policies())),
    "access_audit_registry": lambda s, d: portable(A.access_audit(rentals(s, d), indexed_policies(s, d))),
    "filter_kind_counts": _indexed(A.filter_kind_counts),
    "permission_matrix": _indexed(A.permission_matrix),
    "permission_matrix_long": _indexed(
        lambda r: A.permission_matrix_long(A.permission_matrix(r))
    ),
    "column_block_rate": _registry(A.column_block_rate),
    "hidden_columns": _registry(A.hidden_columns),
}
