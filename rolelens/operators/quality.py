"""Data-quality checks, outliers, de-duplication and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolelens.functions import scalar as S
from rolelens.operators.ranks import locate
from rolelens.operators.summary import named
from rolelens.schema import REQUIRED_KEYS, require

SENTINEL = "N"
SENTINEL_COLUMNS = ("birth_year", "gender", "user_type", "station_id")

# Limits beyond which a rental is an outlier: (above, below) per column.
STEWARD_LIMITS = {"usage_min": (480, 0), "distance_meter": (30000, 0)}
OPERATION_LIMITS = {"usage_min": (480, 1), "distance_meter": (30000, 10)}


# --- filters -----------------------------------------------------------------------------------


def active_filter(df: DataFrame) -> DataFrame:
    require(df, "usage_min")
    return df.where(F.col("usage_min") > 0)


def not_null_keys(df: DataFrame, keys: Sequence[str] = REQUIRED_KEYS) -> DataFrame:
    require(df, *keys)
    return df.dropna(subset=list(keys))


def sentinel_filter(
    df: DataFrame, columns: Sequence[str] = SENTINEL_COLUMNS, value: str = SENTINEL
) -> DataFrame:
    """Drop rows holding the missing-value mark; NULL is kept."""
    require(df, *columns)
    marked = reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(value) for c in columns])
    return df.where(~marked)


def valid_age(df: DataFrame, lo: int = 1940, hi: int = 2010) -> DataFrame:
    require(df, "birth_year")
    return df.where(S.is_valid_birth_year("birth_year", lo, hi))


def numeric_casts(df: DataFrame) -> DataFrame:
    """Numeric copies of the three measures; text that is no number becomes NULL."""
    require(df, "usage_min", "distance_meter", "birth_year")
    return df.withColumns(
        {
            "usage_min_numeric": F.col("usage_min").try_cast("int"),
            "distance_numeric": F.col("distance_meter").try_cast("decimal(12,2)"),
            "birth_year_numeric": S.birth_year_num(),
        }
    )


# --- outliers ----------------------------------------------------------------------------------


def outlier_predicate(limits: Mapping[str, tuple[float, float]]) -> Column:
    arms = [(F.col(c) > above) | (F.col(c) < below) for c, (above, below) in limits.items()]
    return reduce(lambda a, b: a | b, arms)


def outliers(
    df: DataFrame, limits: Mapping[str, tuple[float, float]] = STEWARD_LIMITS
) -> DataFrame:
    """Rows beyond any limit; a NULL measure is not beyond its limit."""
    require(df, *limits)
    return df.where(outlier_predicate(limits))


def outlier_measures(
    df: DataFrame, limits: Mapping[str, tuple[float, float]] = STEWARD_LIMITS
) -> dict[str, Column]:
    require(df, *limits)
    count, total = F.count_if(outlier_predicate(limits)), F.count("*")
    return {"rentals": total, "outliers": count, "outlier_pct": S.pct(count, total)}


def outlier_summary(
    df: DataFrame, limits: Mapping[str, tuple[float, float]] = STEWARD_LIMITS
) -> DataFrame:
    """Rows, outliers and their share, in one pass; the share of an empty table is NULL."""
    return df.agg(*named(outlier_measures(df, limits)))


def outlier_sample(
    df: DataFrame,
    limits: Mapping[str, tuple[float, float]] = STEWARD_LIMITS,
    columns: Sequence[str] = ("rental_id", "usage_min", "distance_meter", "district"),
    order: Sequence[Column] | None = None,
    limit: int = 5,
) -> DataFrame:
    """A few outliers, by default the first by rental id."""
    require(df, *columns)
    order = [F.asc("rental_id")] if order is None else list(order)
    return outliers(df, limits).select(*columns).orderBy(*order).limit(limit)


def operational_outlier_top5(df: DataFrame) -> DataFrame:
    return outlier_sample(
        df,
        OPERATION_LIMITS,
        ("rental_id", "station_name", "usage_min", "distance_meter", "district"),
        [F.desc("usage_min"), F.asc("rental_id")],
    )


# --- profiles ----------------------------------------------------------------------------------


def null_measures(df: DataFrame) -> dict[str, Column]:
    return {c: F.count_if(F.col(c).isNull()) for c in df.columns}


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per visible column, one wide row, one pass."""
    return df.agg(*named(null_measures(df)))


def missing_profile(
    df: DataFrame,
    sentinel: str = SENTINEL,
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Per column: NULLs, sentinel marks, values outside the range or unreadable, and their share.

    One aggregate over all columns, turned into one row per column afterwards.
    """
    if ranges is None:
        ranges = {"birth_year": S.VALID_BIRTH_YEARS} if "birth_year" in df.columns else {}
    require(df, *ranges)
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}

    def invalid(c: str) -> Column:
        lo, hi = ranges[c]
        if c == "birth_year":  # the same reading of a year as in valid_age
            return F.col(c).isNotNull() & ~S.is_valid_birth_year(c, lo, hi)
        number = F.col(c).try_cast("double")
        return F.col(c).isNotNull() & ~F.coalesce(number.between(lo, hi), F.lit(False))

    def counts(c: str) -> Column:
        null, mark = F.count_if(F.col(c).isNull()), F.col(c).eqNullSafe(sentinel)
        none = F.lit(0).cast("long")
        marks = F.count_if(mark) if c in text else none
        outside = F.count_if(invalid(c)) if c in ranges else none
        missing = null + marks
        if c in ranges:  # a mark is usually also an invalid value: count the row once
            bad = F.col(c).isNull() | invalid(c)
            missing = F.count_if((bad | mark) if c in text else bad)
        return F.struct(
            F.lit(c).alias("column"),
            null.alias("nulls"),
            marks.alias("sentinels"),
            outside.alias("out_of_range"),
            missing.alias("missing"),
        )

    wide = df.agg(F.count("*").alias("rentals"), F.array(*[counts(c) for c in df.columns]).alias("profile"))
    return wide.select("rentals", F.inline("profile")).select(
        "column",
        "nulls",
        "sentinels",
        "out_of_range",
        "missing",
        S.pct(F.col("missing"), F.col("rentals")).alias("missing_pct"),
    )


def invalid_dates(
    df: DataFrame, columns: Sequence[str] = ("rental_date", "return_date")
) -> DataFrame:
    """Rows where a date is present but does not parse."""
    require(df, *columns)
    bad = [F.col(c).isNotNull() & S.as_timestamp(c).isNull() for c in columns]
    return df.where(reduce(lambda a, b: a | b, bad))


def negative_duration(
    df: DataFrame, start: str = "rental_date", end: str = "return_date"
) -> DataFrame:
    require(df, start, end)
    return df.where(S.as_timestamp(end) < S.as_timestamp(start))


# --- duplicates --------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("rental_id",)) -> DataFrame:
    """Keys that occur more than once, with their count."""
    require(df, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def dedupe(
    df: DataFrame, keys: Sequence[str] = ("rental_id",), order: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the remaining columns.

    The minimum of a struct combines map-side: each task sends one row per key to the shuffle,
    however many copies the key has.
    """
    require(df, *keys, *order)
    ranked = [*order, *[c for c in df.columns if c not in {*keys, *order}]]
    if not ranked:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_row"))
    return best.select(
        *[(F.col(c) if c in keys else F.col("_row")[c]).alias(c) for c in df.columns]
    )


# --- samples -----------------------------------------------------------------------------------


def sample_fraction(
    df: DataFrame, fraction: float, key: str = "rental_id", seed: int | None = None
) -> DataFrame:
    """A share of the rows, chosen by a hash of the key: map-only, the same rows on every run.

    Copies of a key stay together, and so do the rows without one. The hash counts with 60 bits, so
    small shares of large tables come out right. With ``seed`` it is Spark's own random row sample.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    if seed is not None:
        return df.sample(fraction=fraction, seed=seed)
    require(df, key)
    cut = int(Fraction(fraction) * 16**FRACTION_DIGITS)
    if cut >= 16**FRACTION_DIGITS:
        return df
    return df.where(F.substring(_key_hash(key), 1, FRACTION_DIGITS) < f"{cut:0{FRACTION_DIGITS}x}")


FRACTION_DIGITS = 15


def _key_hash(key: str) -> Column:
    """32 hex digits; a NULL key hashes like an empty text."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


DIGITS = 3  # hex digits per histogram level: 4,096 rows
TIE_DIGITS = 4


def _digits(column: str, start: int, length: int) -> Column:
    return F.substring(column, start, length)


def sample_exact(df: DataFrame, n: int, key: str = "rental_id") -> DataFrame:
    """Exactly ``n`` rows (or all, when there are fewer): those with the smallest key hash.

    Rows without a key share one hash. Three counts over the key column alone find the hash at
    the cut: by leading digits, by the next digits at the cut, and by whole hash among the few
    (one in 16 million) that share them. One pass over the rows then keeps all hashes up to the
    cut, in place; no task holds the sample. ``_some_copies`` serves a key that is cut in two.
    """
    require(df, key)
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_hash", _key_hash(key))

    def cut(rows: DataFrame, order: Column) -> DataFrame:
        """The group of rows that holds rank ``_rank``, the rank inside it and its size."""
        hist = rows.groupBy("_rank", order.alias("_d")).agg(F.count("*").alias("_n"))
        want = "array(named_struct('slot', 0, 'rank', _rank))"
        return locate(hist, [], "_d", "_n", want, keep=("_n",))

    def narrowed(rows: DataFrame, order: Column, found: DataFrame) -> DataFrame:
        one = F.broadcast(found.select(F.col("_d").alias("_at"), F.col("within").alias("_next")))
        inside = rows.join(one, order == F.col("_at"))
        return inside.select("_hash", F.col("_next").alias("_rank"))

    lead, following = _digits("_hash", 1, DIGITS), _digits("_hash", 1 + DIGITS, DIGITS)
    keys = hashed.select("_hash", F.lit(n).cast("long").alias("_rank"))
    in_first = narrowed(keys, lead, cut(keys, lead))
    in_second = narrowed(in_first, following, cut(in_first, following))
    last = cut(in_second, F.col("_hash"))

    # "~" sorts after every hex digit: past the cut hash when all its rows are drawn, and past
    # everything when there are fewer than n rows and so no cut.
    bound = F.when(F.col("within") == F.col("_n"), F.concat("_d", F.lit("~"))).otherwise(F.col("_d"))
    passed = hashed.where(F.col("_hash") < F.coalesce(last.select(bound).scalar(), F.lit("~")))
    split = last.where("within < _n").select(F.col("_d").alias("_at"), F.col("within").alias("_take"))
    copies = hashed.join(F.broadcast(split), F.col("_hash") == F.col("_at"))
    return passed.drop("_hash").unionByName(_some_copies(copies, df.columns))


def _some_copies(copies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_take`` of the rows that share one key, however many there are.

    Identical rows collapse to one with a count. The rest rank by a hash of the row: a histogram
    finds the cut, and only the rows sharing its leading digits (one in 65,536) meet in a window.
    When no key is split the input is empty and AQE drops this branch, scans included.
    """
    rows = (
        copies.groupBy("_take", *columns)
        .agg(F.count("*").alias("_c"))
        .withColumn("_row", _row_hash(columns))
        .withColumn("_lead", _digits("_row", 1, TIE_DIGITS))
    )
    hist = rows.groupBy("_take", "_lead").agg(F.sum("_c").alias("_c"))
    want = "array(named_struct('slot', 0, 'rank', _take))"
    edge = locate(hist, ["_take"], "_lead", "_c", want).select(
        F.col("_take").alias("_t"), F.col("_lead").alias("_edge"), "within"
    )
    before = Window.partitionBy("_lead").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("within") - F.coalesce(F.sum("_c").over(before), F.lit(0))
    inside = (F.col("_take") == F.col("_t")) & (F.col("_lead") <= F.col("_edge"))
    kept = rows.join(F.broadcast(edge), inside).withColumn(
        "_keep", F.when(F.col("_lead") < F.col("_edge"), F.col("_c")).otherwise(F.least("_c", left))
    )
    # identical rows come back in portions, dealt out before they are written out
    portions = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_keep") - 1).cast("long"), F.lit(PORTION).cast("long")))
    dealt = kept.where("_keep > 0").withColumn("_from", portions).repartition("_row", "_from")
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_keep") - F.col("_from"), F.lit(PORTION).cast("long"))))
    return dealt.withColumn("_copy", one).select(*columns)


PORTION = 100_000


def _row_hash(columns: Sequence[str]) -> Column:
    """32 hex digits of all values, at full precision, and of which are NULL."""
    parts = [*columns, *[F.col(c).isNull() for c in columns]]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *parts)), 16, "0") for i in (0, 1)])
