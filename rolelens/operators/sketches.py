"""Distinct counts from stored sketches: what a scope holds is the union of its parts, and no scan.

One row per group of the keys (district and day unless told otherwise) and column, with a HyperLogLog sketch made by
Spark's own functions, the rows and whether a NULL is among them. A load adds the rows of its own data;
sketches of several loads are united when they are read, or once by ``merge``. The exact form stays
``summary.distinct_counts``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.operators import filters
from rolelens.operators import policy as P
from rolelens.schema import HiddenColumnError, require
from rolelens.sources.versions import VersionedTable

#: log2 of a sketch's slots. A sketch takes at most 4 KB, and less while it has met few values.
LG_SLOTS = 12
DAY = "rental_day"

_TYPES = {DAY: T.DateType()}
_MADE = [
    T.StructField("column", T.StringType()),
    T.StructField("sketch", T.BinaryType()),
    T.StructField("nulls", T.BooleanType()),
    T.StructField("rentals", T.LongType()),
]


def relative_error(lg_slots: int = LG_SLOTS) -> float:
    """The standard deviation of an estimate of many values, as a share of their number."""
    return 1.04 / 2 ** (lg_slots / 2)


def _key(name: str) -> Column:
    return S.as_timestamp("rental_date").cast("date") if name == DAY else F.col(name)


def distinct_sketches(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("district", DAY), lg_slots: int = LG_SLOTS
) -> DataFrame:
    """keys, column, sketch, nulls, rentals: one pass, combined map-side. NULL keys form a group."""
    require(df, *columns, *["rental_date" if k == DAY else k for k in keys])
    text = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)]
    narrow = df.select(*[_key(k).alias(k) for k in keys], *text)
    made = narrow.groupBy(*keys).agg(
        F.count("*").alias("rentals"),
        *[F.hll_sketch_agg(f"_{i}", lg_slots).alias(f"_sketch_{i}") for i in range(len(columns))],
        *[F.max(F.col(f"_{i}").isNull()).alias(f"_nulls_{i}") for i in range(len(columns))],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_sketch_{i}").alias("sketch"), F.col(f"_nulls_{i}").alias("nulls"))
        for i, c in enumerate(columns)
    ]
    return made.select(*keys, F.inline(F.array(*rows)), "rentals")


def united(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group and column, of any number of rows with sketches."""
    return sketches.groupBy(*keys, "column").agg(
        F.hll_union_agg("sketch").alias("sketch"), F.max("nulls").alias("nulls"), F.sum("rentals").alias("rentals")
    )


def estimated(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, rentals and an estimate for each column; NULL counts as one value, as in ``distinct_counts``."""
    whole = united(sketches, by).withColumn(
        "_values", F.hll_sketch_estimate("sketch") + F.coalesce(F.col("nulls").cast("long"), F.lit(0))
    )
    return whole.groupBy(*by).agg(
        F.coalesce(F.max("rentals"), F.lit(0)).alias("rentals"),
        *[F.coalesce(F.max(F.when(F.col("column") == c, F.col("_values"))), F.lit(0)).alias(c) for c in columns],
    )


class DistinctStore:
    """Sketches of a table that grows by loads, under a folder that every executor can reach."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        columns: Sequence[str],
        keys: Sequence[str] = ("district", DAY),
        lg_slots: int = LG_SLOTS,
    ):
        if clash := {c for c in keys if c in {f.name for f in _MADE}}:
            raise ValueError(f"no key may be named {', '.join(sorted(clash))}")
        self.columns, self.keys, self.lg_slots = tuple(columns), tuple(keys), lg_slots
        own = [T.StructField(k, _TYPES.get(k, T.StringType())) for k in keys]
        self.table = VersionedTable(spark, path, T.StructType([*own, *_MADE]))

    def add(self, rows: DataFrame, load_id: str | None = None) -> int:
        """Add the sketches of a load; returns the version. A load id counts once."""
        made = distinct_sketches(rows, self.columns, self.keys, self.lg_slots)
        return self.table.commit(made.withColumns({k: F.col(k).cast(_TYPES.get(k, "string")) for k in self.keys}), load_id)

    def merge(self) -> int:
        """Unite the sketches of all loads, unless another writer comes in between."""
        return self.table.compact(lambda rows: united(rows, self.keys))

    def distinct_counts(self, where: str | None = None, by: Sequence[str] = (), version: int | None = None) -> DataFrame:
        """Estimates for the rows that meet a filter over the keys; a filter over other columns is an error."""
        require(self.table.read(version), *by)
        return estimated(self._scope(where, version), self.columns, by)

    def role_counts(self, policies: Iterable[P.Policy], role: str, table: str = P.TABLE) -> DataFrame:
        """Estimates for what a role sees, for the sketched columns that it sees. No policy is no access."""
        policy = P.effective_policy(policies, role, table)
        seen = set(policy.visible(self.columns))
        columns = [c for c in self.columns if c in seen]
        if not columns:
            raise HiddenColumnError(f"role {role} sees none of {', '.join(self.columns)}")
        return estimated(self._scope(None if policy.unrestricted else policy.row_filter, None), columns)

    def _scope(self, where: str | None, version: int | None) -> DataFrame:
        stored = self.table.read(version)
        if where is None:
            return stored
        used = filters.read(self.table.spark, where).columns
        if other := [c for c in used if c not in {k.lower() for k in self.keys}]:
            raise AnalysisException(f"sketches are kept by {', '.join(self.keys)} and not by {', '.join(other)}: {where}")
        return stored.where(where)
