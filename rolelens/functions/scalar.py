"""Column expressions shared by the operators. All are built-in, ANSI-safe and NULL on bad input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ten-year age groups: born 2005 or later, 1995-2004, 1985-1994 … and before 1965.
AGE_GROUPS = ("10s", "20s", "30s", "40s", "50s", "60s+")
YOUNGEST_SINCE = 2005

WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Hours [start, end) of each band of the day; hours between bands are "other".
TIME_BANDS = (
    (0, 6, "dawn"),
    (7, 9, "morning"),
    (12, 14, "noon"),
    (17, 19, "evening"),
    (20, 24, "night"),
)

VALID_BIRTH_YEARS = (1940, 2010)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean(c: str | Column) -> Column:
    """Average from an exact sum, so the result does not depend on summation order."""
    return F.try_divide(F.sum(_col(c)).cast("double"), F.count(_col(c)))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is 0 or NULL."""
    return F.round(F.try_divide(part.cast("double") * 100, whole), digits)


def as_timestamp(c: str | Column) -> Column:
    """Zone-free timestamp; text that does not parse becomes NULL. No-op on a typed column."""
    return _col(c).try_cast("timestamp_ntz")


def hour_of_day(c: str | Column = "rental_date") -> Column:
    return F.hour(as_timestamp(c))


def day_of_week(c: str | Column = "rental_date") -> Column:
    """1 = Sunday … 7 = Saturday."""
    return F.dayofweek(as_timestamp(c))


def _pick(labels: Sequence[str], position: Column) -> Column:
    """Label at a position counted from 0, evaluated once per row; NULL for a NULL position.

    Not ``element_at``: over literals it takes a NULL position for a known one.
    """
    return F.get(F.array(*[F.lit(x) for x in labels]), position)


def weekday_name(c: str | Column = "rental_date") -> Column:
    return _pick(WEEKDAYS, day_of_week(c) - 1)


def birth_year_num(c: str | Column = "birth_year") -> Column:
    """Birth year as a number; ``'1990.0'`` counts as 1990, junk is NULL."""
    return _col(c).try_cast("double").try_cast("int")


def age_group(c: str | Column = "birth_year") -> Column:
    """Ten-year label. The oldest group also takes missing and unreadable years."""
    year = F.coalesce(birth_year_num(c), F.lit(0)).cast("double")
    decades = ((YOUNGEST_SINCE + 9 - year) / 10).cast("int")
    last = len(AGE_GROUPS) - 1
    return _pick(AGE_GROUPS, F.least(F.lit(last), F.greatest(F.lit(0), decades)))


def is_valid_birth_year(
    c: str | Column = "birth_year", lo: int = VALID_BIRTH_YEARS[0], hi: int = VALID_BIRTH_YEARS[1]
) -> Column:
    """True or false, never NULL."""
    return F.coalesce(birth_year_num(c).between(lo, hi), F.lit(False))


def time_band(
    c: str | Column = "rental_date", bands: Sequence[tuple[int, int, str]] = TIME_BANDS
) -> Column:
    """Name of the band holding the hour, ``other`` between bands, NULL without a time."""
    labels = [next((n for lo, hi, n in bands if lo <= h < hi), "other") for h in range(24)]
    return _pick(labels, hour_of_day(c))
