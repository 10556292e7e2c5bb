"""Shares, lift, cross-tabs and age statistics. Everything after the first aggregate is small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolelens.functions import scalar as S
from rolelens.operators.quality import valid_age
from rolelens.operators.summary import numeric_summary
from rolelens.schema import require


def share(
    df: DataFrame, keys: Mapping[str, Column], limit: int | None = None, digits: int = 2
) -> DataFrame:
    """Rows per group and their percentage of all rows, largest first.

    The total is a scalar subquery over the same grouped counts (Spark reuses the exchange), so
    no window gathers all groups in one task.
    """
    counts = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("rentals"))
    total = counts.agg(F.sum("rentals")).scalar()
    out = counts.select(*keys, "rentals", S.pct(F.col("rentals"), total, digits).alias("pct"))
    out = out.orderBy(F.desc("rentals"), *[F.asc(k) for k in keys])
    return out if limit is None else out.limit(limit)


def district_share(df: DataFrame, limit: int = 10) -> DataFrame:
    require(df, "district")
    return share(df, {"district": F.col("district")}, limit)


def gender_share(df: DataFrame) -> DataFrame:
    require(df, "gender")
    return share(df, {"gender": F.col("gender")})


def user_type_share(df: DataFrame) -> DataFrame:
    require(df, "user_type")
    return share(df, {"user_type": F.col("user_type")})


def age_share(df: DataFrame) -> DataFrame:
    """Age groups among rows with a valid birth year."""
    return share(valid_age(df), {"age_group": S.age_group()})


def _counts_within(df: DataFrame, within: str, segment: Column, name: str) -> DataFrame:
    return df.groupBy(within, segment.alias(name)).agg(F.count("*").alias("rentals"))


def district_age_share(df: DataFrame, top: int = 5, digits: int = 2) -> DataFrame:
    """Age groups (valid birth years) within each of the districts with most such rentals."""
    require(df, "district", "birth_year")
    counts = _counts_within(valid_age(df), "district", S.age_group(), "age_group")
    # one row per district holds its few age groups, so the leaders need no second look at the rows
    districts = (
        counts.where(F.col("district").isNotNull())
        .groupBy("district")
        .agg(
            F.sum("rentals").alias("district_rentals"),
            F.collect_list(F.struct("age_group", "rentals")).alias("groups"),
        )
        .orderBy(F.desc("district_rentals"), F.asc("district"))
        .limit(top)
    )
    return districts.select("district", "district_rentals", F.inline("groups")).select(
        "district",
        "age_group",
        "rentals",
        "district_rentals",
        S.pct(F.col("rentals"), F.col("district_rentals"), digits).alias("pct"),
    )


def dominant_age(df: DataFrame) -> DataFrame:
    """Most common age group (valid birth years) per district; ties go to the younger group."""
    require(df, "district", "birth_year")
    counts = _counts_within(valid_age(df), "district", S.age_group(), "age_group")
    best = counts.groupBy("district").agg(
        F.min(F.struct((-F.col("rentals")).alias("neg"), F.col("age_group"))).alias("top"),
        F.sum("rentals").alias("district_rentals"),
    )
    return best.select(
        "district",
        F.col("top.age_group").alias("age_group"),
        (-F.col("top.neg")).alias("rentals"),
        S.pct(-F.col("top.neg"), F.col("district_rentals")).alias("pct"),
    )


def segment_lift(
    df: DataFrame, segment: Column, within: str = "district", name: str = "age_group"
) -> DataFrame:
    """Share of a segment inside each group, divided by its share in the whole table.

    Both sides of the join come from the same grouped counts. The overall side has one row per
    segment; AQE turns the join into a broadcast when that side is small at run time.
    """
    require(df, within)
    counts = _counts_within(df, within, segment, name)
    per_group = counts.withColumn("_group", F.sum("rentals").over(Window.partitionBy(within)))
    total = counts.agg(F.sum("rentals")).scalar()
    overall = counts.groupBy(F.col(name).alias("_segment")).agg(F.sum("rentals").alias("_overall"))
    joined = per_group.join(overall, F.col(name).eqNullSafe(F.col("_segment")))
    inside = F.col("rentals").cast("double") / F.col("_group")
    outside = F.col("_overall").cast("double") / total
    return joined.select(
        within,
        name,
        "rentals",
        F.round(inside * 100, 2).alias("pct_within"),
        F.round(outside * 100, 2).alias("pct_overall"),
        F.round(inside / outside, 4).alias("lift"),
    )


def gender_age_crosstab(df: DataFrame) -> DataFrame:
    """Age groups (valid birth years) by gender; the male share leaves missing genders out."""
    require(df, "gender", "birth_year")
    gender = F.col("gender")
    male, female = F.count_if(gender == "M"), F.count_if(gender == "F")
    missing = F.count_if(gender.isNull())
    return (
        valid_age(df)
        .groupBy(S.age_group().alias("age_group"))
        .agg(
            male.alias("male"),
            female.alias("female"),
            missing.alias("missing"),
            F.count("*").alias("total"),
            S.pct(male, male + female).alias("male_pct"),
        )
    )


def age_stats(df: DataFrame, as_of_year: int) -> DataFrame:
    """Mean, median, range and sample deviation of age over valid birth years.

    Rows collapse to one per birth year first (71 at most); the moments are exact integers.
    """
    years = (
        valid_age(df)
        .groupBy(S.birth_year_num().alias("year"))
        .agg(F.count("*").alias("n"))
        .select((F.lit(as_of_year) - F.col("year")).cast("long").alias("age"), "n")
    )
    count = F.sum("n")
    total = F.sum(F.col("age") * F.col("n"))
    squares = F.sum(F.col("age") * F.col("age") * F.col("n"))
    # n * sum(x^2) - sum(x)^2 in decimals: exact at any row count
    wide = "decimal(38,0)"
    spread = count.cast("decimal(18,0)") * squares.cast("decimal(20,0)") - (
        total.cast("decimal(18,0)") * total.cast("decimal(20,0)")
    )
    variance = F.try_divide(
        F.try_divide(spread.cast(wide).cast("double"), count.cast("double")),
        (count - 1).cast("double"),
    )
    return years.agg(
        F.coalesce(count, F.lit(0)).alias("rentals"),
        F.try_divide(total.cast("double"), count).alias("avg_age"),
        F.percentile("age", 0.5, F.col("n")).alias("median_age"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        F.round(F.sqrt(variance), 6).alias("stddev_age"),
    )


def top_birth_years(df: DataFrame, as_of_year: int, limit: int = 5) -> DataFrame:
    """Commonest valid birth years with age and percentage."""
    out = share(valid_age(df), {"birth_year": S.birth_year_num()}, limit)
    return out.withColumn("age", F.lit(as_of_year) - F.col("birth_year"))


def _by_age_group(df: DataFrame, column: str, name: str) -> DataFrame:
    out = numeric_summary(valid_age(df), column, keys={"age_group": S.age_group()})
    return out.select(
        "age_group", "rentals", F.col("avg").alias(f"avg_{name}"), F.col("median").alias(f"median_{name}")
    )


def age_group_usage(df: DataFrame) -> DataFrame:
    require(df, "birth_year", "usage_min")
    return _by_age_group(df, "usage_min", "usage")


def age_group_distance(df: DataFrame) -> DataFrame:
    require(df, "birth_year", "distance_meter")
    return _by_age_group(df, "distance_meter", "distance")
