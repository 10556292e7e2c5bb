"""Inline rentals for operator tests."""

import datetime
from decimal import Decimal

from rolelens.schema import RENTAL_COLUMNS, RENTAL_SCHEMA

BASE = {
    "station_id": "s1",
    "station_name": "One",
    "rental_date": datetime.datetime(2024, 12, 1, 13, 55, 19),
    "return_date": datetime.datetime(2024, 12, 1, 14, 1, 57),
    "usage_min": 6,
    "distance_meter": Decimal("661.11"),
    "birth_year": "1998",
    "gender": "F",
    "user_type": "member",
    "district": "A",
}


def rental(i, **changes):
    row = {"rental_id": f"r{i}", **BASE, **changes}
    if row["distance_meter"] is not None:
        row["distance_meter"] = Decimal(str(row["distance_meter"]))
    return tuple(row[c] for c in RENTAL_COLUMNS)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), RENTAL_SCHEMA)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
