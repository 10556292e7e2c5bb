"""Grouped reports: every "count and averages by …" table is one spec over one operator."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.functions import scalar as S
from rolelens.schema import require


def _start_of_day() -> Column:
    """Truncated without a detour over the session's time zone, as ``date_trunc`` takes."""
    return S.as_timestamp("rental_date").cast("date").cast("timestamp_ntz")


def _start_of_hour() -> Column:
    return F.timestamp_add("HOUR", S.hour_of_day(), _start_of_day())


# name -> (source column, expression builder)
KEYS: dict[str, tuple[str, Callable[[], Column]]] = {
    "district": ("district", lambda: F.col("district")),
    "gender": ("gender", lambda: F.col("gender")),
    "user_type": ("user_type", lambda: F.col("user_type")),
    "station_id": ("station_id", lambda: F.col("station_id")),
    "station_name": ("station_name", lambda: F.col("station_name")),
    "age_group": ("birth_year", lambda: S.age_group()),
    "hour": ("rental_date", lambda: S.hour_of_day()),
    "day_of_week": ("rental_date", lambda: S.day_of_week()),
    "weekday": ("rental_date", lambda: S.weekday_name()),
    "rental_hour": ("rental_date", lambda: _start_of_hour()),
    "rental_day": ("rental_date", lambda: _start_of_day()),
    "time_band": ("rental_date", lambda: S.time_band()),
}

# name -> (source column or None, aggregate builder). Distinct counts here leave NULL out.
MEASURES: dict[str, tuple[str | None, Callable[[], Column]]] = {
    "rentals": (None, lambda: F.count("*")),
    "avg_usage": ("usage_min", lambda: S.mean("usage_min")),
    "avg_distance": ("distance_meter", lambda: S.mean("distance_meter")),
    "stations": ("station_id", lambda: F.count_distinct("station_id")),
    "unique_rentals": ("rental_id", lambda: F.count_distinct("rental_id")),
    "first_rental": ("rental_date", lambda: F.min("rental_date")),
    "last_rental": ("rental_date", lambda: F.max("rental_date")),
}


@dataclasses.dataclass(frozen=True)
class SegmentSpec:
    """Which keys and measures; ``by_count`` ranks by rentals, otherwise rows follow the keys."""

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    by_count: bool = True
    limit: int | None = None

    def columns(self) -> set[str]:
        used = {KEYS[k][0] for k in self.keys} | {MEASURES[m][0] for m in self.measures}
        return {c for c in used if c is not None}


_COUNT_USAGE = ("rentals", "avg_usage")
_COUNT_BOTH = ("rentals", "avg_usage", "avg_distance")

SPECS: dict[str, SegmentSpec] = {
    "district_top10": SegmentSpec(("district",), _COUNT_BOTH, limit=10),
    "district_stats": SegmentSpec(("district",), _COUNT_BOTH),
    "district_operations": SegmentSpec(("district",), (*_COUNT_BOTH, "stations")),
    "gender_stats": SegmentSpec(("gender",), _COUNT_USAGE),
    "gender_stats_distance": SegmentSpec(("gender",), _COUNT_BOTH),
    "age_group_stats": SegmentSpec(("age_group",), _COUNT_BOTH, by_count=False),
    "station_top10": SegmentSpec(("station_id", "station_name"), _COUNT_BOTH, limit=10),
    "station_popular": SegmentSpec(
        ("station_id", "station_name"), (*_COUNT_USAGE, "unique_rentals"), limit=10
    ),
    "station_efficiency": SegmentSpec(
        ("station_id", "station_name", "district"),
        (*_COUNT_BOTH, "first_rental", "last_rental"),
        limit=15,
    ),
    "hourly_counts": SegmentSpec(("hour",), ("rentals",), by_count=False),
    "hourly_usage": SegmentSpec(("hour",), _COUNT_USAGE, by_count=False),
    "hourly_load": SegmentSpec(("hour",), (*_COUNT_USAGE, "stations"), by_count=False),
    "weekday_operations": SegmentSpec(
        ("day_of_week", "weekday"), (*_COUNT_USAGE, "stations"), by_count=False
    ),
    "weekday_pattern": SegmentSpec(("weekday",), _COUNT_USAGE),
    "user_type_stats": SegmentSpec(("user_type",), _COUNT_BOTH),
    "user_type_operations": SegmentSpec(("user_type",), (*_COUNT_BOTH, "stations")),
    "peak_hour": SegmentSpec(("hour",), ("rentals",), limit=1),
    "station_gender": SegmentSpec(("station_name", "gender"), _COUNT_BOTH),
    "district_station_hour": SegmentSpec(
        ("district", "station_name", "rental_hour"), _COUNT_USAGE, limit=50
    ),
    "station_gender_day": SegmentSpec(
        ("station_name", "gender", "rental_day"), ("rentals", "avg_distance")
    ),
    "time_band": SegmentSpec(("time_band",), ("rentals",)),
}


def segment_report(
    df: DataFrame,
    keys: Mapping[str, Column],
    measures: Mapping[str, Column],
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Group, aggregate, order, cut. NULL keys form a group.

    Aggregates combine map-side, so a hot key costs one partial row per task. With ``limit`` Spark
    keeps only the top rows per task (TakeOrderedAndProject) and no sort of all groups runs.
    """
    out = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def segment(df: DataFrame, name: str) -> DataFrame:
    """One of the named reports. Ties in the ranking follow the keys, so results repeat."""
    spec = SPECS[name]
    require(df, *sorted(spec.columns()))
    ranked = [F.desc("rentals")] if spec.by_count else []
    return segment_report(
        df,
        {k: KEYS[k][1]() for k in spec.keys},
        {m: MEASURES[m][1]() for m in spec.measures},
        [*ranked, *[F.asc(k) for k in spec.keys]],
        spec.limit,
    )


def district_age(df: DataFrame, as_of_year: int, limit: int = 20) -> DataFrame:
    """District by age in the given year; the year is an argument so that results repeat."""
    require(df, "district", "birth_year", "usage_min", "distance_meter")
    return segment_report(
        df,
        {"district": F.col("district"), "age": F.lit(as_of_year) - S.birth_year_num()},
        {m: MEASURES[m][1]() for m in _COUNT_BOTH},
        [F.desc("rentals"), F.asc("district"), F.asc("age")],
        limit,
    )


def fused_segments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Several reports from one scan, as a long table with a ``section`` column.

    Grouping sets share the scan and the decoding, and each task sends one row per group of each
    set. Meant for keys with few values (district, hour, weekday …); cut or rank the sections
    afterwards, on the small result. Columns a section does not use are NULL.
    """
    specs = {n: SPECS[n] for n in names}
    for spec in specs.values():
        require(df, *sorted(spec.columns()))
    keys = list(dict.fromkeys(k for s in specs.values() for k in s.keys))
    measures = list(dict.fromkeys(m for s in specs.values() for m in s.measures))
    sets = list(dict.fromkeys(s.keys for s in specs.values()))

    # One bit per key, highest first; a set bit means the key is rolled up in that row.
    def rolled_up(used: tuple[str, ...]) -> int:
        return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used)

    sources = sorted({c for s in specs.values() for c in s.columns()})
    narrow = df.select(*sources, *[KEYS[k][1]().alias(f"key_{k}") for k in keys])
    grouped = narrow.groupingSets(
        [[F.col(f"key_{k}") for k in s] for s in sets], *[F.col(f"key_{k}") for k in keys]
    ).agg(F.grouping_id().alias("gid"), *[MEASURES[m][1]().alias(m) for m in measures])

    sections = F.create_map(
        *[
            part
            for s in sets
            for part in (
                F.lit(rolled_up(s)).cast("long"),
                F.array(*[F.lit(n) for n, spec in specs.items() if spec.keys == s]),
            )
        ]
    )
    long = grouped.withColumn("section", F.explode(sections[F.col("gid")]))
    wanted = {m: [n for n, s in specs.items() if m in s.measures] for m in measures}
    return long.select(
        "section",
        *[F.col(f"key_{k}").alias(k) for k in keys],
        *[F.when(F.col("section").isin(wanted[m]), F.col(m)).alias(m) for m in measures],
    )


def section(fused: DataFrame, name: str) -> DataFrame:
    """One report out of ``fused_segments``, equal to ``segment(df, name)``."""
    spec = SPECS[name]
    ranked = [F.desc("rentals")] if spec.by_count else []
    out = (
        fused.where(F.col("section") == name)
        .select(*spec.keys, *spec.measures)
        .orderBy(*ranked, *[F.asc(k) for k in spec.keys])
    )
    return out if spec.limit is None else out.limit(spec.limit)
