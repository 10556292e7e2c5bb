"""The four role reports: named tables over a scoped rentals table."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.operators import policy as P
from rolelens.operators import quality as Q
from rolelens.operators import segment as G
from rolelens.operators import summary as M
from rolelens.plans import rollup as U
from rolelens.sources.load import schema_report

ID_COLUMNS = ("rental_id", "station_id", "district")

Scalars = Callable[[Sequence[str]], Mapping[str, Column]]


@dataclasses.dataclass(frozen=True)
class Report:
    """``segments`` are grouped sections, ``scalars`` one-row tables over the base table (given the visible
    columns), ``tables`` the others. ``measures`` are what the base table counts for them."""

    segments: tuple[str, ...]
    scalars: Mapping[str, Scalars]
    tables: Mapping[str, Callable[[DataFrame, U.Rollup, U.Detail], DataFrame]]
    measures: Callable[[DataFrame], Mapping[str, Column]] = lambda df: {}
    quantiles: Mapping[str, float] = dataclasses.field(default_factory=lambda: M.MEDIAN)
    ranked: str | None = None  # the segment that counts distinct rentals


def _nulls(df: DataFrame) -> dict[str, Column]:
    return {f"nulls_{c}": m for c, m in Q.null_measures(df).items()}


def _outliers(df: DataFrame, limits: Mapping = Q.STEWARD_LIMITS) -> dict[str, Column]:
    return {"outliers": Q.outlier_measures(df, limits)["outliers"]}


def _outlier_summary(_: Sequence[str]) -> dict[str, Column]:
    count, rows = U.total("outliers"), U.total("n")
    return {"rentals": rows, "outliers": count, "outlier_pct": S.pct(count, rows)}


def _summaries(kind: str) -> dict[str, Callable[[DataFrame, U.Rollup, U.Detail], DataFrame]]:
    columns = {"usage": "usage_min", "distance": "distance_meter"}
    return {f"{short}_{kind}": lambda df, _, detail, c=c: detail.summary(c) for short, c in columns.items()}


_COUNT = {"row_count": lambda _: {"rentals": U.total("n")}}
_NULL_COUNTS = {"null_counts": lambda columns: {c: U.total(f"nulls_{c}") for c in columns}}
_BASICS = {
    "schema": lambda df, *_: schema_report(df),
    "distinct_counts": lambda df, _, detail: detail.distinct_counts(),
}

REPORTS: dict[str, Report] = {
    P.STEWARD: Report(
        ("district_top10", "gender_stats", "age_group_stats", "hourly_counts"),
        {**_COUNT, **_NULL_COUNTS, "outlier_summary": _outlier_summary},
        {**_BASICS, **_summaries("summary"), "outlier_sample": lambda df, *_: Q.outlier_sample(df)},
        lambda df: {**_nulls(df), **_outliers(df)},
    ),
    P.DISTRICT_ANALYST: Report(
        ("district_stats", "gender_stats", "station_top10", "hourly_counts", "user_type_stats"),
        {**_COUNT, **_NULL_COUNTS},
        {**_BASICS, **_summaries("summary")},
        _nulls,
    ),
    P.OPERATION: Report(
        ("district_operations", "station_efficiency", "hourly_load", "user_type_operations", "weekday_operations"),
        {**_COUNT, "outlier_summary": _outlier_summary},
        {
            **_BASICS,
            **_summaries("quantiles"),
            "outlier_top5": lambda df, *_: Q.operational_outlier_top5(df),
            "kpis": lambda df, rollup, _: rollup.kpis(),
        },
        lambda df: {**_outliers(df, Q.OPERATION_LIMITS), **M.kpi_measures()},
        M.QUARTILES,
    ),
    P.MARKETING_PARTNER: Report(
        (
            "district_stats",
            "gender_stats_distance",
            "station_popular",
            "hourly_usage",
            "user_type_operations",
            "weekday_pattern",
            "peak_hour",
        ),
        {
            **_COUNT,
            "averages": lambda _: {"avg_usage": U.mean("usage_min"), "avg_distance": U.mean("distance_meter")},
        },
        {**_BASICS, **_summaries("summary")},
        ranked="station_popular",
    ),
}


def role_report(scoped: DataFrame, role: str) -> dict[str, DataFrame]:
    """A role's report on its scoped table, as named DataFrames; nothing is shown or collected.

    Building it runs two reads of the table, whose small results are stored (see ``rollup``); an outlier
    section reads it once more when it is shown.
    """
    if role not in REPORTS:
        raise PermissionError(f"no report for role {role}")
    report = REPORTS[role]
    rollup = U.Rollup(scoped, report.segments, report.measures(scoped))
    detail = rollup.detail(report.quantiles, report.ranked)
    extra = {report.ranked: detail.unique_rentals()} if report.ranked else {}
    return {
        **{name: rollup.scalars(build(scoped.columns)) for name, build in report.scalars.items()},
        **{name: build(scoped, rollup, detail) for name, build in report.tables.items()},
        **{name: rollup.segment(name, extra.get(name)) for name in report.segments},
    }


def long_form(table: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """A table as rows of section, key, measure and value.

    ``key`` joins the given columns and all that are no numbers, in the table's order; every other
    column is a measure.
    """
    numeric = {f.name for f in table.schema if isinstance(f.dataType, T.NumericType)} - set(keys)
    labels = [F.coalesce(_text(f), F.lit("NULL")) for f in table.schema if f.name not in numeric]
    measures = [
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
        for c in table.columns
        if c in numeric
    ]
    key = F.concat_ws("|", *labels) if labels else F.lit("")
    return table.select(F.lit(section).alias("section"), key.alias("key"), F.inline(F.array(*measures)))


def _text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col(field.name).cast("string")


def report_long(scoped: DataFrame, role: str) -> DataFrame:
    """The whole report of a role as one table: section, key, measure, value."""
    parts = [
        long_form(table, name, G.SPECS[name].keys if name in G.SPECS else ())
        for name, table in role_report(scoped, role).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def show_report(tables: Mapping[str, DataFrame], rows: int = 20, truncate: bool = True) -> None:
    """Print each table, 20 rows by default."""
    for name, table in tables.items():
        print(f"== {name}")
        table.show(rows, truncate=truncate)
