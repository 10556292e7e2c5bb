"""Row and column policies: who sees which part of a table.

A policy is an ordinary plan, ``where(predicate)`` then ``select(visible columns)``, so Catalyst
pushes the predicate to the Parquet scan and prunes the hidden columns. The predicate may use
hidden columns. Scoping narrows queries; it does not secure the files underneath.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.operators import filters
from rolelens.operators.quality import dedupe
from rolelens.schema import POLICY_SCHEMA, RENTAL_COLUMNS, require

TABLE = "rentals"

# Values of the four standard policies.
STEWARD = "data_steward"
DISTRICT_ANALYST = "district_analyst"
OPERATION = "operation"
MARKETING_PARTNER = "marketing_partner"
MARKETING_YEARS = ("1994", "2004")  # compared as text


@dataclasses.dataclass(frozen=True)
class Policy:
    """One named filter on one table, for one role."""

    role: str
    name: str
    table: str = TABLE
    row_filter: str | None = None
    all_rows: bool = False
    include_columns: Sequence[str] | None = None
    exclude_columns: Sequence[str] | None = None

    def __post_init__(self):
        if self.include_columns is not None and self.exclude_columns is not None:
            raise ValueError(f"policy {self.name}: name the visible or the hidden columns, not both")
        if self.row_filter is None and not self.all_rows:
            raise ValueError(f"policy {self.name}: give a row filter or all_rows=True")

    @property
    def unrestricted(self) -> bool:
        """All rows visible. A TRUE filter next to the all-rows flag is the same thing."""
        return self.row_filter is None or self.row_filter.strip().upper() == "TRUE"

    def predicate(self) -> Column:
        return F.lit(True) if self.unrestricted else F.expr(self.row_filter)

    def visible(self, columns: Sequence[str]) -> list[str]:
        if self.include_columns is not None:
            return list(self.include_columns)
        hidden = set(self.exclude_columns or ())
        return [c for c in columns if c not in hidden]


def equals_filter(column: str, value: str) -> str:
    """SQL text of ``column = 'value'`` with the value quoted safely."""
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"{column} = '{quoted}'"


def equals_filters(column: str, value: Column) -> Column:
    """``equals_filter`` for a column of values."""
    slashes = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    quoted = F.replace(slashes, F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit(f"{column} = '"), quoted, F.lit("'"))


def equals_index(column: str, value: Column) -> dict[str, Column]:
    """What ``filters.indexed`` would find in ``equals_filters`` of the same column and values."""
    pair = F.struct(F.lit(column).alias("column"), value.alias("value"))
    return {
        "filter_columns": F.array(F.lit(column)),
        "equals": F.array(pair),
        "rest": F.lit(None).cast("string"),
    }


def standard_policies(district: str, table: str = TABLE) -> list[Policy]:
    """The four roles: everything; one district; no personal data; one district and age range."""
    no_birth_year = [c for c in RENTAL_COLUMNS if c != "birth_year"]
    no_personal = [c for c in no_birth_year if c != "gender"]
    lo, hi = MARKETING_YEARS
    in_district = equals_filter("district", district)
    return [
        Policy(STEWARD, "steward_filter", table, "TRUE", True, None, ()),
        Policy(DISTRICT_ANALYST, "district_filter", table, in_district, False, no_birth_year),
        Policy(OPERATION, "operation_filter", table, "TRUE", False, no_personal),
        Policy(
            MARKETING_PARTNER,
            "marketing_filter",
            table,
            f"{in_district} AND (birth_year >= '{lo}' AND birth_year <= '{hi}')",
            False,
            no_birth_year,
        ),
    ]


def validate(policy: Policy, df: DataFrame) -> Policy:
    """Check a policy against the table's schema, when it is registered and when it is used; no data is read.

    The filter has to be a boolean over existing columns, made of listed kinds of expressions only.
    """
    require(df, *(policy.include_columns or ()), *(policy.exclude_columns or ()))
    if not policy.unrestricted:
        filters.read(df.sparkSession, policy.row_filter)
        empty = df.limit(0)
        checked = empty.select(F.expr(policy.row_filter).alias("keep"))
        empty.where(policy.predicate()).schema  # noqa: B018  analysed here: an aggregate is no filter
        if checked.schema["keep"].dataType != T.BooleanType():
            raise AnalysisException(f"policy {policy.name}: the row filter is not a boolean")
    return policy


def effective_policy(policies: Iterable[Policy], role: str, table: str = TABLE) -> Policy:
    """The one filter granted to the role. No filter means no access."""
    found = [p for p in policies if p.role == role and p.table == table]
    if not found:
        raise PermissionError(f"role {role} has no filter on {table}: access denied")
    if len(found) > 1:
        names = ", ".join(p.name for p in found)
        raise ValueError(f"role {role} has several filters on {table}: {names}")
    return found[0]


def row_filter(df: DataFrame, policy: Policy) -> DataFrame:
    """Rows for which the predicate is true; a NULL predicate hides the row."""
    return df if policy.unrestricted else df.where(policy.predicate())


def column_include(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*columns)


def column_exclude(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*[c for c in df.columns if c not in set(columns)])


def policy_view(
    df: DataFrame, policies: Iterable[Policy], role: str, table: str = TABLE, view: str | None = None
) -> DataFrame:
    """The table as one role sees it.

    ``where().select()`` alone leaks: the analyzer adds a hidden column back below the
    projection when a later filter or sort names it. The alias (or the temp view, when ``view``
    is given) stops that, so hidden columns no longer resolve.
    """
    policy = validate(effective_policy(policies, role, table), df)
    columns = policy.visible(df.columns)
    require(df, *columns)
    scoped = row_filter(df, policy).select(*columns)
    if view is None:
        return scoped.alias(f"{table}_{re.sub(r'[^0-9A-Za-z_]', '_', role)}")
    scoped.createOrReplaceTempView(view)
    return df.sparkSession.table(view)


# --- registry: policies as a table -----------------------------------------------------------


def policy_registry(
    spark: SparkSession, policies: Iterable[Policy], table: DataFrame | None = None
) -> DataFrame:
    """Policies as rows; with ``table`` each one is first checked against its schema."""
    policies = list(policies)
    if table is not None:
        for p in policies:
            validate(p, table)
    rows = [
        (
            p.role,
            p.name,
            p.table,
            p.row_filter,
            p.all_rows,
            None if p.include_columns is None else list(p.include_columns),
            None if p.exclude_columns is None else list(p.exclude_columns),
        )
        for p in policies
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def policy_upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by (table, name), otherwise add. ``new`` has the registry's schema.

    Of several new rows for one name the smallest counts, by role, filter and the other columns.
    """
    one = dedupe(new, ("table", "name"), ("role", "row_filter"))
    kept = registry.join(one.select("table", "name"), ["table", "name"], "left_anti")
    return kept.unionByName(one)


def policy_drop(registry: DataFrame, table: str, name: str) -> DataFrame:
    return registry.where(~((F.col("table") == table) & (F.col("name") == name)))


def policy_list(registry: DataFrame, table: str | None = None) -> DataFrame:
    """Filters with predicate, number of listed columns and whether all columns are the base."""
    rows = registry if table is None else registry.where(F.col("table") == table)
    listed = F.col("include_columns")
    return rows.select(
        "name",
        "row_filter",
        F.when(listed.isNull(), 0).otherwise(F.size(listed)).alias("column_count"),
        listed.isNull().alias("has_wildcard"),
    )


def policy_count(registry: DataFrame, table: str) -> DataFrame:
    return registry.where(F.col("table") == table).agg(F.count("*").alias("filters"))


def role_policies(registry: DataFrame, role: str, table: str = TABLE) -> list[Policy]:
    """The role's filters on the table. Two rows are enough to tell one from several."""
    rows = registry.where((F.col("role") == role) & (F.col("table") == table)).limit(2).collect()
    return [Policy(**r.asDict()) for r in rows]


# --- grants ----------------------------------------------------------------------------------

RESOURCE_TYPES = ("DATABASE", "TABLE", "COLUMNS", "FILTER", "LOCATION")


def grant(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Add grants; granting again changes nothing."""
    return registry.unionByName(new).dropDuplicates()


def revoke(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove exactly the named grants."""
    return registry.join(gone, registry.columns, "left_anti")


def grant_list(registry: DataFrame, role: str | None = None) -> DataFrame:
    """Number of grants per role."""
    rows = registry if role is None else registry.where(F.col("role") == role)
    return rows.groupBy("role").agg(F.count("*").alias("permissions"))


def filter_resource(table: Column, name: Column) -> Column:
    """What a grant on a filter names: the table and the filter, as names repeat across tables.

    Slashes within either name are escaped, so that no two filters share one grant.
    """

    def escaped(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))

    return F.concat(escaped(table), F.lit("/"), escaped(name))


def role_grants(
    registry: DataFrame, database: str = "analytics", location: str = "warehouse"
) -> DataFrame:
    """The grants each policy's role gets: describe the database and the table, select the listed
    columns and with the filter, and reach the location."""

    def one(kind: str, resource: Column, permission: str) -> Column:
        return F.struct(
            F.lit(kind).alias("resource_type"),
            resource.alias("resource"),
            F.lit(permission).alias("permission"),
        )

    listed = F.concat("table", F.lit("("), F.array_join("include_columns", ","), F.lit(")"))
    columns = one("COLUMNS", listed, "SELECT")
    wanted = F.array(
        one("DATABASE", F.lit(database), "DESCRIBE"),
        one("TABLE", F.col("table"), "DESCRIBE"),
        F.when(F.col("include_columns").isNotNull(), columns),
        one("FILTER", filter_resource(F.col("table"), F.col("name")), "SELECT"),
        one("LOCATION", F.concat(F.lit(f"{location}/"), "table"), "DATA_LOCATION_ACCESS"),
    )
    return registry.select("role", F.inline(F.array_compact(wanted)))


def open_table(
    df: DataFrame, registry: DataFrame, grants: DataFrame, role: str, table: str = TABLE
) -> DataFrame:
    """The role's view of a table, when the registry has its filter and it may select with it.

    A grant to describe the table, or to select from it without a filter, opens nothing.
    """
    policy = effective_policy(role_policies(registry, role, table), role, table)
    allowed = grants.where(
        (F.col("role") == role)
        & (F.col("resource_type") == "FILTER")
        & (F.col("resource") == filter_resource(F.lit(table), F.lit(policy.name)))
        & (F.col("permission") == "SELECT")
    )
    if allowed.isEmpty():
        raise PermissionError(f"role {role} may not select with filter {policy.name}")
    return policy_view(df, [policy], role, table)


def denied_roles(
    roles: DataFrame, registry: DataFrame, grants: DataFrame, table: str = TABLE
) -> DataFrame:
    """Those of the given roles that ``open_table`` would turn away: not exactly one filter, or no grant on it."""
    usable = grants.where("resource_type = 'FILTER' AND permission = 'SELECT'").select("role", "resource")
    filters = registry.where(F.col("table") == table).groupBy("role").agg(
        F.count("*").alias("filters"), F.min("name").alias("name")
    )
    single = filters.where("filters = 1").withColumn("resource", filter_resource(F.lit(table), F.col("name")))
    admitted = single.join(usable, ["role", "resource"], "left_semi")
    return roles.select("role").distinct().join(admitted, "role", "left_anti")
