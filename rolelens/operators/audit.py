"""What each role can see, computed from the data and the policies."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.operators import filters
from rolelens.operators.policy import Policy, policy_registry
from rolelens.schema import PERSONAL_COLUMNS, RENTAL_COLUMNS, require
from rolelens.session import ensure_checkpoint_dir


# --- over the data -------------------------------------------------------------------------------


#: Policies that are counted by an expression each.
DIRECT = 16
#: Different conditions that are counted in one scan.
EXPRESSIONS = 200


def access_audit(df: DataFrame, policies: Iterable[Policy] | DataFrame) -> DataFrame:
    """Per policy: visible rows, columns and districts, and the rows of the whole table.

    ``policies`` are a list or a registry. Policies are looked up, not tried: a filter's ``column = 'value'``
    parts become rows (columns, values, role), and the table is grouped once by each such set of columns
    and by district, whatever the number of roles. Only what else a filter asks is a
    conditional count, one for each different text; ``EXPRESSIONS`` of them share a scan. The groups
    are checkpointed, so building the audit runs its scans; they are joined with the policies by value.

    A filter that is refused shows nothing; its records and districts are 0. In a list it is an error, and
    a list of up to ``DIRECT`` policies takes a conditional count for each.
    """
    require(df, "district")
    if not isinstance(policies, DataFrame):
        policies = list(policies)
        if len(policies) <= DIRECT:
            return _direct(df, policies)
    ensure_checkpoint_dir(df.sparkSession)
    index = _policy_index(df, policies)
    if isinstance(policies, DataFrame):
        index = index.checkpoint()
    shapes = [list(r.names) for r in index.select("names").distinct().collect()]  # sets of columns
    conditions = index.where("rest IS NOT NULL").select("rest").distinct().orderBy("rest").toLocalIterator()
    texts = [r.rest for r in islice(conditions, EXPRESSIONS)]
    counted = _counted(df, shapes, texts, whole=True)
    while texts := [r.rest for r in islice(conditions, EXPRESSIONS)]:
        counted = counted.unionByName(_counted(df, shapes, texts))
    per_role = index.join(counted, ["key", "condition"], "left")
    total = counted.where(F.col("key") == _TABLE_KEY).agg(F.coalesce(F.sum("records"), F.lit(0))).scalar()
    return per_role.select(
        "role",
        F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        "columns",
        F.coalesce("districts", F.lit(0)).cast("long").alias("districts"),
        F.coalesce(total, F.lit(0)).cast("long").alias("table_rows"),
    )


def _direct(df: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Rows collapse to one per district with a conditional count per policy; nothing is run yet."""
    for p in policies:
        if not p.unrestricted:
            filters.read(df.sparkSession, p.row_filter)
    seen = [F.count_if(p.predicate()).alias(f"_p{i}") for i, p in enumerate(policies)]
    by_district = df.groupBy("district").agg(F.count("*").alias("_all"), *seen)
    has_district = F.col("district").isNotNull()
    wide = by_district.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("table_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(p.role).alias("role"),
                    F.coalesce(F.sum(f"_p{i}"), F.lit(0)).alias("records"),
                    F.lit(len(p.visible(df.columns))).cast("long").alias("columns"),
                    F.count_if(has_district & (F.col(f"_p{i}") > 0)).alias("districts"),
                )
                for i, p in enumerate(policies)
            ]
        ).alias("roles"),
    )
    return wide.select("table_rows", F.inline("roles")).select(
        "role", "records", "columns", "districts", "table_rows"
    )


#: The key of the row that counts the whole table, and of policies that see nothing.
_TABLE_KEY, _NOTHING = "*", "-"


def _key(names: Sequence[str], values: Sequence[Column]) -> Column:
    """One text for a set of columns and their values; only equal sets have equal texts."""
    return _packed(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.array(*values).cast("array<string>"))


def _packed(names: Column, values: Column) -> Column:
    return F.to_json(F.struct(names.alias("names"), values.alias("values")))


def _policy_index(df: DataFrame, policies: Iterable[Policy] | DataFrame) -> DataFrame:
    """role, columns (how many), names and key of the equalities, rest and condition."""
    registry = policies if isinstance(policies, DataFrame) else policy_registry(df.sparkSession, policies)
    rows = filters.indexed(registry)
    # what is refused is not even tried
    usable = F.col("filter_columns").isNotNull() & ~(F.col("row_filter").isNull() & ~F.col("all_rows"))
    # equalities on other than text columns compare by casting, so they stay conditions
    text = {f.name.lower() for f in df.schema if isinstance(f.dataType, T.StringType)}
    fits = F.forall("equals", lambda e: e["column"].isin(sorted(text)))
    no_text = F.array().cast("array<string>")
    names = F.when(fits, F.transform("equals", lambda e: e["column"])).otherwise(no_text)
    rest = F.when(_unrestricted() | ~usable, None).when(fits, F.col("rest")).otherwise(F.col("row_filter"))
    every = F.size(visible_columns(df.columns)).cast("long")
    own = rows.select(
        "role",
        every.alias("columns"),
        F.when(_unrestricted(), no_text).otherwise(names).alias("names"),
        F.when(fits & ~_unrestricted(), F.transform("equals", lambda e: e["value"])).otherwise(no_text).alias("values"),
        rest.alias("rest"),
        usable.alias("usable"),
    )
    return own.select(
        "role", "columns", "names", "rest",
        F.when(F.col("usable"), _packed(F.col("names"), F.col("values"))).otherwise(F.lit(_NOTHING)).alias("key"),
        F.coalesce("rest", F.lit("")).alias("condition"),
    )


def _counted(df: DataFrame, shapes: list[list[str]], texts: list[str], whole: bool = False) -> DataFrame:
    """key, condition, records, districts for all values of the sets of columns in ``shapes``, from one scan.

    With ``whole`` also without a condition, and for the whole table under ``_TABLE_KEY``.
    """
    real = {c.lower(): c for c in df.columns}
    shapes = [[real[n] for n in names] for names in ([[], *[s for s in shapes if s]] if whole else shapes)]
    keys = list(dict.fromkeys(["district", *[c for names in shapes for c in names]]))
    sets = list(dict.fromkeys(tuple(k for k in keys if k == "district" or k in names) for names in shapes))
    counts = [F.count_if(F.expr(t)) for t in texts]
    if whole:
        counts.insert(0, F.count("*"))
    grouped = (
        df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
        .agg(F.grouping_id().alias("_gid"), F.array(*counts).alias("_counts"))
        .checkpoint()
    )
    names_of = F.array(*[F.lit(t) for t in ([""] if whole else []) + texts])
    out = None
    for names in shapes:
        used = tuple(k for k in keys if k == "district" or k in names)
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used)
        # the policy's order of the columns is by their names
        ordered = sorted(names, key=str.lower)
        rows = grouped.where(F.col("_gid") == gid).select(
            _key([n.lower() for n in ordered], [F.col(n) for n in ordered]).alias("key"),
            "district",
            F.posexplode("_counts").alias("_slot", "n"),
        )
        part = rows.groupBy("key", "_slot").agg(
            F.sum("n").alias("records"),
            F.count_if(F.col("district").isNotNull() & (F.col("n") > 0)).alias("districts"),
        )
        part = part.select("key", names_of[F.col("_slot")].alias("condition"), "records", "districts")
        if whole and not names:
            table = part.where("condition = ''").withColumn("key", F.lit(_TABLE_KEY))
            part = part.unionByName(table)
        out = part if out is None else out.unionByName(part)
    return out


def access_ratio(audit: DataFrame) -> DataFrame:
    """Visible rows as % of the table's rows, with one and with two decimals."""
    records, whole = F.col("records"), F.col("table_rows")
    return audit.select(
        "role",
        "records",
        S.pct(records, whole, 1).alias("access_pct"),
        S.pct(records, whole, 2).alias("access_pct_2"),
    )


def districts_per_role(df: DataFrame, policies: Iterable[Policy] | DataFrame) -> DataFrame:
    return access_audit(df, policies).select("role", "districts")


# --- over the registry -----------------------------------------------------------------------------


def visible_columns(all_columns: Sequence[str]) -> Column:
    """Array of the columns a registry row shows."""
    everything = F.array(*[F.lit(c) for c in all_columns])
    return (
        F.when(F.col("include_columns").isNotNull(), F.col("include_columns"))
        .when(
            F.col("exclude_columns").isNotNull(),
            F.array_except(everything, F.col("exclude_columns")),
        )
        .otherwise(everything)
    )


def _hidden(all_columns: Sequence[str]) -> Column:
    everything = F.array(*[F.lit(c) for c in all_columns])
    return F.array_except(everything, visible_columns(all_columns))


def _unrestricted() -> Column:
    """As when a table is opened: all rows are asked for, or the filter is TRUE."""
    text = F.upper(F.trim("row_filter"))
    return F.coalesce(text == "TRUE", F.col("all_rows"))


def _mentions(column: str) -> Column:
    """The filter's tree has the column. The registry is an indexed one."""
    return F.coalesce(F.array_contains("filter_columns", column.lower()), F.lit(False))


def hidden_columns(
    registry: DataFrame, all_columns: Sequence[str] = RENTAL_COLUMNS
) -> DataFrame:
    """Columns each role lacks, compared with the table."""
    hidden = _hidden(all_columns)
    return registry.select(
        "role", F.size(hidden).alias("hidden_count"), hidden.alias("hidden_columns")
    )


def filter_kinds(
    registry: DataFrame, all_columns: Sequence[str] = RENTAL_COLUMNS
) -> DataFrame:
    """Each policy's kind: none, column, district, row (another single column) or multi.

    A row without filter that does not ask for all rows, or with a refused one, cannot be opened: its kind is
    ``invalid``.
    """
    registry = filters.indexed(registry)
    dims = sum((_mentions(c).cast("int") for c in all_columns[1:]), _mentions(all_columns[0]).cast("int"))
    kind = (
        F.when(F.col("row_filter").isNull() & ~F.col("all_rows") | F.col("filter_columns").isNull(), "invalid")
        .when(_unrestricted() & (F.size(_hidden(all_columns)) == 0), "none")
        .when(_unrestricted(), "column")
        .when(dims > 1, "multi")
        .when(_mentions("district"), "district")
        .otherwise("row")
    )
    return registry.select("role", "name", kind.alias("filter_kind"))


def filter_kind_counts(
    registry: DataFrame, all_columns: Sequence[str] = RENTAL_COLUMNS
) -> DataFrame:
    """Roles per kind of filter. One policy per role, so rows are roles."""
    return (
        filter_kinds(registry, all_columns)
        .groupBy("filter_kind")
        .agg(F.count("*").alias("roles"))
    )


TRAITS = (
    "full_data_access",
    "district_filter",
    "age_filter",
    "personal_info_block",
    "column_restriction",
)


def permission_matrix(
    registry: DataFrame, all_columns: Sequence[str] = RENTAL_COLUMNS
) -> DataFrame:
    """Role by trait, 0 or 1. Full access is about rows: a role with hidden columns can have it."""
    registry = filters.indexed(registry)
    hidden = _hidden(all_columns)
    personal = F.array(*[F.lit(c) for c in PERSONAL_COLUMNS])
    tests = (
        _unrestricted(),
        ~_unrestricted() & _mentions("district"),
        ~_unrestricted() & _mentions("birth_year"),
        F.arrays_overlap(hidden, personal),
        F.size(hidden) > 0,
    )
    return registry.select("role", *[t.cast("int").alias(n) for n, t in zip(TRAITS, tests)])


def permission_matrix_long(matrix: DataFrame) -> DataFrame:
    """One row per role and trait."""
    return matrix.unpivot("role", list(TRAITS), "trait", "applied")


def column_block_rate(
    registry: DataFrame, all_columns: Sequence[str] = RENTAL_COLUMNS
) -> DataFrame:
    """Per column: share of the policies that hide it. One aggregate, then one row per column."""
    hidden = _hidden(all_columns)
    wide = registry.select(hidden.alias("hidden")).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count_if(F.array_contains("hidden", c)).alias("blocked_roles"),
                    F.count("*").alias("roles"),
                )
                for c in all_columns
            ]
        ).alias("rates")
    )
    return wide.select(F.inline("rates")).select(
        "column",
        "blocked_roles",
        S.pct(F.col("blocked_roles"), F.col("roles")).alias("block_pct"),
    )
