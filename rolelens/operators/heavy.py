"""Rankings by count over keys of very many values, without grouping all of them.

Every key belongs to one of a fixed number of buckets by its hash, and a bucket's rows are an upper bound for each
of its keys. The keys of the fullest buckets are counted exactly; the k-th of those counts is a lower
bound for the result, so of the other buckets only those that hold at least as many rows need counting. Where keys
are skewed these are few or none. Where they are not, the bound decides little and the rest of the keys is
counted as in a plain grouping. The result is exact either way.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.operators.segment import KEYS, MEASURES, SPECS, segment_report
from rolelens.schema import require
from rolelens.session import ensure_checkpoint_dir

#: Counters per task; also the most rows that a list of buckets has.
BUCKETS = 1 << 16
#: Buckets that are opened first, per row of the result; one more would mostly hold light keys only.
FIRST = 4


@dataclasses.dataclass(frozen=True)
class Heaviest:
    """The most frequent keys with ``rentals`` (their rows), and what finding them took."""

    rows: DataFrame
    counted_keys: int
    opened_buckets: int


def heaviest(
    df: DataFrame, keys: Mapping[str, Column], k: int, buckets: int = BUCKETS, first: int = FIRST
) -> Heaviest:
    """The k keys with the most rows; ties follow the keys. NULL is a key; fewer keys than k are all returned.

    Reads the key columns two or three times. Shuffled are one counter per task and bucket that it meets,
    and the keys of opened buckets, those of the fullest twice where others follow. Text keys have to be of the
    default collation, as others are equal with different hashes.
    """
    if k < 1 or buckets < 1 or first < 1:
        raise ValueError("k, buckets and first are at least 1")
    ensure_checkpoint_dir(df.sparkSession)
    narrow = df.select(*[c.alias(n) for n, c in keys.items()])
    for field in narrow.schema:
        if isinstance(field.dataType, T.StringType) and field.dataType != T.StringType():
            raise ValueError(f"{field.name} has a collation of its own")
    names = list(keys)
    hashed = narrow.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    totals = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows")).checkpoint()
    fullest = [r["_bucket"] for r in totals.orderBy(F.desc("_rows"), "_bucket").limit(first * k).collect()]

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*names).agg(F.count("*").alias("rentals")).checkpoint()

    ranking = [F.desc("rentals"), *[F.asc(n) for n in names]]
    found = counted(hashed.where(F.col("_bucket").isin(fullest)))
    best = [r["rentals"] for r in found.orderBy(F.desc("rentals")).limit(k).select("rentals").collect()]
    least = best[-1] if len(best) == k else 0
    opened = totals.where(F.col("_bucket").isin(fullest) | (F.col("_rows") >= least)).select("_bucket")
    opened_buckets = opened.count()
    if opened_buckets > len(fullest):
        # Once more with the first ones: a union of stored counts does not do, as each keeps what its filters said of
        # the rows, and Spark may then fail to plan it. At most ``buckets`` numbers are broadcast.
        found = counted(hashed.join(F.broadcast(opened), "_bucket", "left_semi"))
    return Heaviest(found.orderBy(*ranking).limit(k), found.count(), opened_buckets)


def heavy_segment(df: DataFrame, name: str, buckets: int = BUCKETS, first: int = FIRST) -> DataFrame:
    """``segment(df, name)`` of a report ranked by count and cut: the keys first, the measures of these keys then.

    So distinct counts and averages are made for as many groups as the report has rows.
    """
    spec = SPECS[name]
    if not spec.by_count or spec.limit is None:
        raise ValueError(f"{name} is not a top list by count")
    require(df, *sorted(spec.columns()))
    keys = {k: KEYS[k][1]() for k in spec.keys}
    top = heaviest(df, keys, spec.limit, buckets, first).rows.select(*[F.col(k).alias(f"_{k}") for k in spec.keys])
    same = F.lit(True)
    for k, value in keys.items():
        same = same & value.eqNullSafe(F.col(f"_{k}"))
    # at most ``limit`` rows are broadcast
    rows = df.join(F.broadcast(top), same, "left_semi")
    order = [F.desc("rentals"), *[F.asc(k) for k in spec.keys]]
    return segment_report(rows, keys, {m: MEASURES[m][1]() for m in spec.measures}, order, spec.limit)
