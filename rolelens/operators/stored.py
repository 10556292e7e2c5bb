"""The registry of policies and grants as stored tables that many writers can change.

Every change appends rows; of the rows of one policy (table and name) or one grant the newest version
counts, and a row marked as gone removes it. What is known of each filter is stored with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.operators import filters
from rolelens.operators import policy as P
from rolelens.operators.quality import dedupe
from rolelens.schema import GRANT_SCHEMA, POLICY_SCHEMA
from rolelens.sources.versions import VersionedTable

_GONE = T.StructField("gone", T.BooleanType())
_POLICY_KEY = ("table", "name")


def _nullable(*schemas: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for s in schemas for f in s] + [_GONE])


class StoredRegistry:
    """Policies and grants under a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._policies = VersionedTable(spark, f"{path}/policies", _nullable(POLICY_SCHEMA, filters.INDEX_SCHEMA))
        self._grants = VersionedTable(spark, f"{path}/grants", _nullable(GRANT_SCHEMA))

    def versions(self) -> list[int]:
        return self._policies.versions()

    def policies(self, version: int | None = None) -> DataFrame:
        """The policies, with what is known of their filters; also as they were in a former version."""
        return _current(self._policies.read(version, versioned=True), _POLICY_KEY).drop("gone")

    def grants(self, version: int | None = None) -> DataFrame:
        return _current(self._grants.read(version, versioned=True), GRANT_SCHEMA.names).drop("gone")

    def upsert(self, new: DataFrame | Iterable[P.Policy], table: DataFrame | None = None) -> int:
        """Add policies or replace those of the same table and name; returns the version.

        With ``table`` every policy of a list is first checked against its schema.
        """
        if not isinstance(new, DataFrame):
            new = P.policy_registry(self.spark, new, table)
        one = dedupe(filters.indexed(new), _POLICY_KEY, ("role", "row_filter"))
        return self._policies.commit(one.withColumn("gone", F.lit(False)))

    def drop(self, table: str, name: str) -> int:
        """Remove a policy; removing one that is not there changes nothing but the version."""
        row = {"table": table, "name": name, "role": "", "all_rows": False, "gone": True}
        schema = self._policies.schema
        return self._policies.commit(self.spark.createDataFrame([[row.get(f.name) for f in schema]], schema))

    def grant(self, new: DataFrame) -> int:
        return self._grants.commit(new.select(*GRANT_SCHEMA.names).distinct().withColumn("gone", F.lit(False)))

    def revoke(self, gone: DataFrame) -> int:
        return self._grants.commit(gone.select(*GRANT_SCHEMA.names).distinct().withColumn("gone", F.lit(True)))

    def open_table(self, df: DataFrame, role: str, table: str = P.TABLE) -> DataFrame:
        """The role's view by the stored policies and grants."""
        policies = self.policies().select(*POLICY_SCHEMA.names)
        return P.open_table(df, policies, self.grants(), role, table)

    def compact(self) -> None:
        """Leave one folder with the current rows of each table, unless another writer comes in between."""
        self._policies.compact(lambda rows: _current(rows, _POLICY_KEY))
        self._grants.compact(lambda rows: _current(rows, GRANT_SCHEMA.names))


def _current(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key that is not gone; combined map-side. A version has each key once."""
    fields = [c for c in rows.columns if c not in keys and c != "_version"]
    newest = F.max_by(F.struct(*fields), "_version").alias("row")
    state = rows.groupBy(*keys).agg(newest).select(*keys, "row.*")
    return state.where(~F.col("gone")).select(*[c for c in rows.columns if c != "_version"])
