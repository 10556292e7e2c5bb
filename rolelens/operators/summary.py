"""Counts, distinct counts, one-row numeric summaries, quantiles and operating ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.operators.ranks import locate
from rolelens.schema import require
from rolelens.session import ensure_checkpoint_dir

MEDIAN = {"median": 0.5}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}

# Width of a first-level bucket: whole minutes, and 100 m (10,000 two-decimal values).
BUCKET_STEP = {"usage_min": 1, "distance_meter": 100}
# The first level has at most 2 * FIRST_LEVEL + 1 buckets per group, each further one NEXT_LEVEL + 1.
FIRST_LEVEL = 10_000
NEXT_LEVEL = 1 << 16
# Located buckets (groups x quantiles) up to this count, which is checked, are broadcast.
BROADCAST_ROWS = 10_000


def named(measures: Mapping[str, Column]) -> list[Column]:
    return [m.alias(n) for n, m in measures.items()]


def row_count_measures(df: DataFrame) -> dict[str, Column]:
    return {"rentals": F.count("*")}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(*named(row_count_measures(df)))


def distinct_counts(
    df: DataFrame, columns: Sequence[str], approx: bool = False, rsd: float = 0.05
) -> DataFrame:
    """Distinct values per column in one row; NULL counts as one value.

    Exact: one ``distinct`` per column, each reading only that column. Several ``count_distinct``
    in one aggregate would instead copy every row once per column before the shuffle, with all
    columns in the hash key. ``approx`` is a single pass without any wide shuffle.
    """
    require(df, *columns)
    if approx:
        return df.agg(
            *[
                (
                    F.approx_count_distinct(c, rsd)
                    + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))
                ).alias(c)
                for c in columns
            ]
        )
    parts = [
        df.select(c).distinct().agg(F.lit(c).alias("column"), F.count("*").alias("n"))
        for c in columns
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(*[F.max(F.when(F.col("column") == c, F.col("n"))).alias(c) for c in columns])


def count_distinct_in_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct values of ``column`` per group; NULL is not counted."""
    require(df, *keys, column)
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("distinct_values"))


def average_measures(df: DataFrame, columns: Mapping[str, str]) -> dict[str, Column]:
    require(df, *columns.values())
    return {a: S.mean(c) for a, c in columns.items()}


def averages(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``{alias: column}`` averages, all in one aggregate."""
    return df.agg(*named(average_measures(df, columns)))


def fused_scalars(df: DataFrame, tables: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Several one-row tables from one aggregate, as one struct column per table."""
    flat = [
        m.alias(f"{table}__{n}") for table, measures in tables.items() for n, m in measures.items()
    ]
    return df.agg(*flat).select(
        *[
            F.struct(*[F.col(f"{table}__{n}").alias(n) for n in measures]).alias(table)
            for table, measures in tables.items()
        ]
    )


def numeric_summary(
    df: DataFrame,
    column: str,
    quantiles: Mapping[str, float] = MEDIAN,
    keys: Mapping[str, Column] | None = None,
    step: int | None = None,
    accuracy: int | None = None,
    hist: DataFrame | None = None,
    located: DataFrame | None = None,
) -> DataFrame:
    """Average, minimum, maximum and quantiles of a numeric column, per group or in one row.

    A quantile is the smallest value whose rank reaches ``p`` of the non-NULL rows; NaN counts as
    larger than any number. By default it is exact: a histogram of ``step``-wide buckets tells which
    bucket holds the rank (and gives the average, minimum and maximum). While that bucket holds more
    than one value, its range is cut into ``NEXT_LEVEL`` buckets and only its rows are counted again.
    Each level is one scan; whole numbers in unit buckets need one level, two-decimal values mostly
    two, whatever their spread. Every shuffle carries counts, not rows, and no level has more buckets
    than its constant, so neither a hot value nor many distinct ones gather in one task.

    The histograms are checkpointed here: building the summary runs its scans.

    A caller that has counted already gives ``hist`` (as ``histogram`` makes it, stored), and may go on from
    ``located`` buckets (as ``first_located`` finds them).

    ``accuracy`` switches to ``percentile_approx``: one pass, but each task sends its sketch to a
    single reducer, so keep it small on many partitions.
    """
    require(df, column)
    keys = keys or {}
    value = F.col(column)
    if accuracy is not None:
        sketch = F.percentile_approx(value, list(quantiles.values()), accuracy)
        out = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
            F.count("*").alias("rentals"),
            S.mean(value).alias("avg"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            sketch.alias("_q"),
        )
        picked = [F.col("_q")[i].alias(q) for i, q in enumerate(quantiles)]
        return out.select(*keys, "rentals", "avg", "min", "max", *picked)

    ensure_checkpoint_dir(df.sparkSession)
    narrow = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("_v"))
    narrow = narrow.withColumn("_b", first_bucket(df.schema[column].dataType, "_v", step or BUCKET_STEP.get(column, 1)))
    if hist is None:
        hist = histogram(narrow, list(keys)).checkpoint()
    if located is None:
        located = first_located(hist, quantiles, list(keys))
    found = []
    while True:
        located = located.withColumn("_open", F.col("_lo") < F.col("_hi"))
        if keys:
            located = located.checkpoint()
            open_buckets = located.where("_open").count()
        else:  # a row per quantile
            rows = located.collect()
            located = df.sparkSession.createDataFrame(rows, located.schema)
            open_buckets = sum(r["_open"] for r in rows)
        found.append(located.where("NOT _open").select(*keys, "slot", F.col("_lo").alias("_v")))
        if not open_buckets:
            break
        located = _next_level(narrow, located.where("_open"), list(keys), open_buckets)

    # Histogram rows and located values meet in one small final aggregate.
    totals = hist.withColumn("slot", F.lit(None).cast("int")).withColumn("_v", F.lit(None))
    known = F.when(F.col("_b").isNotNull(), F.col("_n"))
    for part in found:
        totals = totals.unionByName(part, allowMissingColumns=True)
    return totals.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rentals"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum(known)).alias("avg"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
        *[F.max(F.when(F.col("slot") == i, F.col("_v"))).alias(q) for i, q in enumerate(quantiles)],
    )


def finished(hist: DataFrame, values: Mapping[str, Column], quantiles: Sequence[str]) -> DataFrame:
    """The summary of a histogram without groups whose quantiles are known; unknown ones are NULL."""
    known = F.when(F.col("_b").isNotNull(), F.col("_n"))
    kind = hist.schema["_lo"].dataType
    return hist.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rentals"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum(known)).alias("avg"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
    ).select("*", *[values.get(q, F.lit(None)).cast(kind).alias(q) for q in quantiles])


def histogram(narrow: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, sum, minimum and maximum of ``_v`` per bucket ``_b``."""
    return narrow.groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def first_located(hist: DataFrame, quantiles: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """The bucket of each quantile (slot), with the rank within it."""
    wanted = ", ".join(
        f"named_struct('slot', {i}, 'rank', greatest(1L, cast(ceil({p}BD * _total) AS bigint)))"
        for i, p in enumerate(quantiles.values())
    )
    return locate(hist.where("_b IS NOT NULL"), keys, "_b", "_n", f"array({wanted})", keep=("_lo", "_hi"))


def first_bucket(kind: T.DataType, column: str, step: int) -> Column:
    """A non-decreasing function of the column; values are limited in their own type, so nothing overflows."""
    edge = FIRST_LEVEL * step
    if kind.typeName() in ("float", "double"):
        limited = f"floor(greatest({-edge}D, least({edge}D, {column})) / {step})"
        return F.expr(
            f"CASE WHEN isnan({column}) THEN {FIRST_LEVEL + 1}L WHEN {column} IS NOT NULL THEN {limited} END"
        )
    limited = f"cast(greatest({-edge}, least({edge}, {column})) AS bigint) div {step}"
    return F.expr(f"CASE WHEN {column} IS NOT NULL THEN {limited} END")


def sub_bucket(value: Column, low: Column, high: Column) -> Column:
    """The part of a bucket's range, cut into NEXT_LEVEL, in which a value lies; both ends are parts of their own."""
    # halved first, so that no difference of doubles overflows
    lo, hi, own = (c.cast("double") / 2 for c in (low, high, value))
    part = F.nanvl(F.coalesce(F.try_divide(own - lo, hi - lo), F.lit(0.0)), F.lit(0.0)) * (NEXT_LEVEL - 1)
    sub = (
        F.when(value >= high, NEXT_LEVEL)
        .when(value <= low, 0)
        .otherwise(1 + F.least(F.floor(part), F.lit(NEXT_LEVEL - 2)))
    )
    return sub.cast("long")


def _next_level(narrow: DataFrame, pending: DataFrame, keys: list[str], open_buckets: int) -> DataFrame:
    """Cuts each located bucket's range into equal parts and locates its rank among them."""
    wanted = pending.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_b").alias("_at"),
        F.col("slot").alias("_slot"),
        F.col("within").alias("_rank"),
        F.col("_lo").alias("_from"),
        F.col("_hi").alias("_to"),
    )
    if open_buckets <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    match = (F.col("_b") == F.col("_at")) & F.col("_v").between(F.col("_from"), F.col("_to"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    sub = sub_bucket(F.col("_v"), F.col("_from"), F.col("_to"))
    inside = narrow.join(wanted, match).withColumn("_sub", sub)
    hist = inside.groupBy(*keys, "_b", "_slot", "_rank", "_sub").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    at_rank = "array(named_struct('slot', _slot, 'rank', _rank))"
    again = locate(hist, [*keys, "_b", "_slot"], "_sub", "_n", at_rank, keep=("_lo", "_hi"))
    return again.select(*keys, "_b", "_lo", "_hi", "slot", "within")


def quantile_profile(
    df: DataFrame, column: str, quantiles: Mapping[str, float] = QUARTILES, **options
) -> DataFrame:
    """Summary with the quartiles and the 95 % quantile."""
    return numeric_summary(df, column, quantiles, **options)


def kpis(df: DataFrame) -> DataFrame:
    """Operating ratios in one row.

    - ``station_turnover``: rows per station; rows without a station form one station
    - ``avg_efficiency``: mean metres per minute; rows with 0 minutes are left out
    - ``service_coverage``: % of stations with a rental longer than 0 minutes

    Rows collapse to one row per station first, so the distinct counts need no row copies.
    """
    require(df, "station_id", "usage_min", "distance_meter")
    return station_kpis(df.groupBy("station_id").agg(F.count("*").alias("n"), *named(kpi_measures())))


def kpi_measures() -> dict[str, Column]:
    """What the ratios need of a station, apart from its rows; sums of any finer groups will do."""
    speed = F.try_divide(F.col("distance_meter").cast("double"), F.col("usage_min"))
    return {
        "active": F.count_if(F.col("usage_min") > 0),
        "speed_sum": F.sum(speed),
        "speed_n": F.count(speed),
    }


def station_kpis(stations: DataFrame) -> DataFrame:
    """The ratios from one row per station: n and ``kpi_measures``."""
    total = F.count("*")
    active = F.count_if(F.col("active") > 0)
    return stations.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rentals"),
        total.alias("stations"),
        active.alias("active_stations"),
        F.try_divide(F.sum("n").cast("double"), total).alias("station_turnover"),
        F.round(F.try_divide(F.sum("speed_sum"), F.sum("speed_n")), 4).alias("avg_efficiency"),
        S.pct(active, total, 4).alias("service_coverage"),
    )
