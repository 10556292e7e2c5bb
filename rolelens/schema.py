"""Fixed schemas of the rentals table, the policy registry and the grant registry."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and order of the rentals table.
RENTAL_COLUMNS = (
    "rental_id",
    "station_id",
    "station_name",
    "rental_date",
    "return_date",
    "usage_min",
    "distance_meter",
    "birth_year",
    "gender",
    "user_type",
    "district",
)

# A row whose raw text lacks one of these is rejected on load.
REQUIRED_KEYS = ("rental_id", "station_id", "rental_date", "return_date")

# Personal columns; hiding either one counts as protecting personal data.
PERSONAL_COLUMNS = ("birth_year", "gender")

_TYPES = {
    "rental_date": T.TimestampNTZType(),
    "return_date": T.TimestampNTZType(),
    "usage_min": T.IntegerType(),
    "distance_meter": T.DecimalType(12, 2),
}

RENTAL_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES.get(name, T.StringType())) for name in RENTAL_COLUMNS]
)

# Staging form: every field as the text found in the file.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RENTAL_COLUMNS])

POLICY_SCHEMA = T.StructType(
    [
        T.StructField("role", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("row_filter", T.StringType()),
        T.StructField("all_rows", T.BooleanType(), False),
        T.StructField("include_columns", T.ArrayType(T.StringType())),
        T.StructField("exclude_columns", T.ArrayType(T.StringType())),
    ]
)

GRANT_SCHEMA = T.StructType(
    [
        T.StructField("role", T.StringType(), False),
        T.StructField("resource_type", T.StringType(), False),
        T.StructField("resource", T.StringType(), False),
        T.StructField("permission", T.StringType(), False),
    ]
)


class HiddenColumnError(AnalysisException):
    """An operator needs a column that the given (scoped) table does not show."""


def require(df: DataFrame, *columns: str) -> None:
    """Stop with a clear error when ``df`` does not show every named column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise HiddenColumnError(
            f"column(s) {', '.join(missing)} are not visible; visible: {', '.join(df.columns)}"
        )
