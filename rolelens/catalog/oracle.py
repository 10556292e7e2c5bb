"""The same results in plain SQL, for checking the queries on another engine."""

from __future__ import annotations

from fractions import Fraction

DISTRICT = "NATION_20"
AS_OF_YEAR = 2024

RENTALS = """
rentals AS (
  SELECT 'R-' || CAST(e.event_id AS VARCHAR) AS rental_id,
         CAST(e.user_id AS VARCHAR) AS station_id,
         'Station ' || CAST(e.user_id AS VARCHAR) AS station_name,
         e.ts AS rental_date,
         e.ts + to_minutes(CAST(floor(e.value) AS INTEGER)) AS return_date,
         CAST(floor(e.value) AS INTEGER) AS usage_min,
         CAST(e.value * CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS DECIMAL(12,2))
           AS distance_meter,
         CASE WHEN e.user_id % 53 = 0 THEN 'N'
              WHEN e.user_id % 41 = 0 THEN NULL
              ELSE CAST(1940 + (e.user_id * 7) % 71 AS VARCHAR) END AS birth_year,
         CASE WHEN e.user_id % 25 = 0 THEN NULL
              WHEN e.user_id % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
         CASE WHEN e.event_type = 'signup' THEN 'new' ELSE 'member' END AS user_type,
         CASE WHEN e.user_id % 50 = 49 THEN NULL ELSE n.n_name END AS district
  FROM events e
  LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

ALL = (
    "rental_id station_id station_name rental_date return_date usage_min distance_meter "
    "birth_year gender user_type district"
).split()
NO_BIRTH_YEAR = [c for c in ALL if c != "birth_year"]
NO_PERSONAL = [c for c in NO_BIRTH_YEAR if c != "gender"]
MARKETING = f"district = '{DISTRICT}' AND (birth_year >= '1994' AND birth_year <= '2004')"

ROLES = f"""
steward AS (SELECT * FROM rentals),
analyst AS (SELECT {', '.join(NO_BIRTH_YEAR)} FROM rentals WHERE district = '{DISTRICT}'),
operation AS (SELECT {', '.join(NO_PERSONAL)} FROM rentals),
marketing AS (SELECT {', '.join(NO_BIRTH_YEAR)} FROM rentals WHERE {MARKETING})"""


def q(body: str, *more: str) -> str:
    return f"WITH {','.join((RENTALS, ROLES, *more))}\n{body}"


PORTABLE = {
    "rental_date": "strftime(rental_date, '%Y-%m-%d %H:%M:%S.%f')",
    "return_date": "strftime(return_date, '%Y-%m-%d %H:%M:%S.%f')",
    "usage_min": "CAST(usage_min AS BIGINT)",
    "distance_meter": "CAST(distance_meter AS DOUBLE)",
}


def cols(names) -> str:
    return ", ".join(f"{PORTABLE[n]} AS {n}" if n in PORTABLE else n for n in names)


def mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"


YEAR = "TRY_CAST(TRY_CAST(birth_year AS DOUBLE) AS INTEGER)"
VALID = f"{YEAR} BETWEEN 1940 AND 2010"
AGE_GROUP = (
    f"CASE WHEN {YEAR} >= 2005 THEN '10s' WHEN {YEAR} >= 1995 THEN '20s' "
    f"WHEN {YEAR} >= 1985 THEN '30s' WHEN {YEAR} >= 1975 THEN '40s' "
    f"WHEN {YEAR} >= 1965 THEN '50s' ELSE '60s+' END"
)
HOUR = "CAST(hour(rental_date) AS BIGINT)"
DOW = "CAST(dayofweek(rental_date) + 1 AS BIGINT)"
BAND = (
    "CASE WHEN hour(rental_date) < 6 THEN 'dawn' "
    "WHEN hour(rental_date) >= 7 AND hour(rental_date) < 9 THEN 'morning' "
    "WHEN hour(rental_date) >= 12 AND hour(rental_date) < 14 THEN 'noon' "
    "WHEN hour(rental_date) >= 17 AND hour(rental_date) < 19 THEN 'evening' "
    "WHEN hour(rental_date) >= 20 THEN 'night' "
    "WHEN rental_date IS NULL THEN NULL ELSE 'other' END"
)
KEYS = {
    "district": "district",
    "gender": "gender",
    "user_type": "user_type",
    "station_id": "station_id",
    "station_name": "station_name",
    "age_group": AGE_GROUP,
    "hour": HOUR,
    "day_of_week": DOW,
    "weekday": "dayname(rental_date)",
    "rental_hour": "strftime(date_trunc('hour', rental_date), '%Y-%m-%d %H:%M:%S.%f')",
    "rental_day": "strftime(date_trunc('day', rental_date), '%Y-%m-%d %H:%M:%S.%f')",
    "time_band": BAND,
}
MEASURES = {
    "rentals": "count(*)",
    "avg_usage": mean("usage_min"),
    "avg_distance": mean("distance_meter"),
    "stations": "count(DISTINCT station_id)",
    "unique_rentals": "count(DISTINCT rental_id)",
    "first_rental": "strftime(min(rental_date), '%Y-%m-%d %H:%M:%S.%f')",
    "last_rental": "strftime(max(rental_date), '%Y-%m-%d %H:%M:%S.%f')",
}


def grouped(table: str, keys: str, measures: str, limit: int | None = None) -> str:
    k, m = keys.split(), measures.split()
    top = ""
    if limit is not None:
        ties = ", ".join(f"{x} ASC NULLS FIRST" for x in k)
        top = f" ORDER BY rentals DESC, {ties} LIMIT {limit}"
    select = ", ".join([f"{KEYS[x]} AS {x}" for x in k] + [f"{MEASURES[x]} AS {x}" for x in m])
    positions = ", ".join(str(i + 1) for i in range(len(k)))
    return f"SELECT {select} FROM {table} GROUP BY {positions}{top}"


def long_form(section: str, keys: str, measures: str, body: str) -> str:
    """A table as rows of section, key, measure and value."""
    key = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'NULL')" for k in keys.split())
    pairs = ", ".join(f"{{'measure': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in measures.split())
    return (
        f"SELECT '{section}' AS section, {f"concat_ws('|', {key})" if key else "''"} AS key, "
        f"unnest([{pairs}], recursive := true) FROM ({body})"
    )


def segments(table: str, parts: dict[str, tuple[str, str]], limits: dict[str, int] | None = None) -> list[str]:
    return [
        long_form(name, k, m, grouped(table, k, m, (limits or {}).get(name))) for name, (k, m) in parts.items()
    ]


def schema_rows(columns) -> str:
    kind = {"usage_min": "int", "distance_meter": "decimal(12,2)", "rental_date": "timestamp_ntz",
            "return_date": "timestamp_ntz"}
    # the view computes user_type for every row
    rows = ", ".join(
        f"({i}, '{c}', '{kind.get(c, 'string')}', {c != 'user_type'})" for i, c in enumerate(columns, start=1)
    )
    return f"SELECT * FROM (VALUES {rows}) t(position, name, type, nullable)"


def basics(table: str, columns) -> list[str]:
    """The sections that all reports have."""
    ids = "rental_id station_id district"
    return [
        long_form("row_count", "", "rentals", f"SELECT count(*) AS rentals FROM {table}"),
        long_form("schema", "name type nullable", "position", schema_rows(columns)),
        long_form("distinct_counts", "", ids, distinct_counts(table)),
    ]


def summaries(table: str) -> list[str]:
    m = "rentals avg min max median"
    return [
        long_form("usage_summary", "", m, summary(table, "usage_min", MEDIAN)),
        long_form("distance_summary", "", m, summary(table, "distance_meter", MEDIAN)),
    ]


def report(*parts: list[str]) -> str:
    return q("\nUNION ALL ".join(sql for part in parts for sql in part))


BOTH = "rentals avg_usage avg_distance"


def summary(table: str, c: str, probs: dict[str, float]) -> str:
    qs = ", ".join(
        f"CAST(quantile_disc({c}, {p}) AS {'BIGINT' if c == 'usage_min' else 'DOUBLE'}) AS {n}"
        for n, p in probs.items()
    )
    kind = "BIGINT" if c == "usage_min" else "DOUBLE"
    return (
        f"SELECT count(*) AS rentals, {mean(c)} AS avg, CAST(min({c}) AS {kind}) AS min, "
        f"CAST(max({c}) AS {kind}) AS max, {qs} FROM {table}"
    )


MEDIAN = {"median": 0.5}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}

STEWARD_OUT = "usage_min > 480 OR distance_meter > 30000 OR usage_min < 0 OR distance_meter < 0"
OPERATION_OUT = "usage_min > 480 OR distance_meter > 30000 OR usage_min < 1 OR distance_meter < 10"


def outlier_summary(table: str, predicate: str) -> str:
    return (
        f"SELECT count(*) AS rentals, count(*) FILTER (WHERE {predicate}) AS outliers, "
        f"round(CAST(count(*) FILTER (WHERE {predicate}) AS DOUBLE) * 100 / nullif(count(*), 0), 2)"
        f" AS outlier_pct FROM {table}"
    )


def distinct_counts(table: str) -> str:
    out = ", ".join(
        f"count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS {c}"
        for c in ("rental_id", "station_id", "district")
    )
    return f"SELECT {out} FROM {table}"


def share(table: str, keys: str, where: str = "TRUE", limit: int | None = None) -> str:
    k = keys.split()
    by = ", ".join(str(i + 1) for i in range(len(k)))
    top = ""
    if limit is not None:
        top = f" ORDER BY rentals DESC, {', '.join(f'{x} ASC NULLS FIRST' for x in k)} LIMIT {limit}"
    names = ", ".join(f"{KEYS[x]} AS {x}" for x in k)
    return (
        f"SELECT *, round(CAST(rentals AS DOUBLE) * 100 / CAST(sum(rentals) OVER () AS DOUBLE), 2)"
        f" AS pct FROM (SELECT {names}, count(*) AS rentals FROM {table} WHERE {where} GROUP BY {by})"
        f"{top}"
    )


def null_counts(names, table: str) -> str:
    return "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in names) + f" FROM {table}"


def profile() -> str:
    text = {c for c in ALL if c not in PORTABLE}
    parts = []
    for c in ALL:
        mark = f"coalesce({c} = 'N', FALSE)" if c in text else "FALSE"
        bad = "FALSE"
        if c == "birth_year":
            bad = (
                f"{c} IS NOT NULL AND NOT coalesce(TRY_CAST({c} AS DOUBLE) BETWEEN 1940 AND 2010,"
                " FALSE)"
            )
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
            f"count(*) FILTER (WHERE {mark}) AS sentinels, "
            f"count(*) FILTER (WHERE {bad}) AS out_of_range, "
            f"count(*) FILTER (WHERE {c} IS NULL OR {mark} OR ({bad})) AS missing, "
            f"round(CAST(count(*) FILTER (WHERE {c} IS NULL OR {mark} OR ({bad})) AS DOUBLE) * 100 "
            f"/ nullif(count(*), 0), 2) AS missing_pct FROM rentals"
        )
    return "\nUNION ALL ".join(parts)


CSV = f"""
csv AS (
  SELECT * REPLACE (
    CASE WHEN substr(md5(rental_id), 1, 2) = '00' THEN NULL ELSE station_id END AS station_id)
  FROM rentals
)"""
SAMPLE_CUT = f"{int(Fraction(0.156) * 16**15):015x}"  # 60 bits of the sampled share
STORED = "\nstored AS (SELECT * FROM csv WHERE station_id IS NOT NULL)"


def names(columns) -> str:
    return "[" + ", ".join(f"'{c}'" for c in columns) + "]"


POLICIES = f"""
policies AS (
  SELECT 'analyst_' || district AS role, 'district_filter_' || district AS name,
         'rentals' AS "table", 'district = ''' || district || '''' AS row_filter,
         FALSE AS all_rows, {names(NO_BIRTH_YEAR)} AS include_columns,
         CAST(NULL AS VARCHAR[]) AS exclude_columns
  FROM (SELECT DISTINCT district FROM rentals WHERE district IS NOT NULL)
  UNION ALL
  SELECT 'operator_' || station_id, 'station_id_filter_' || station_id, 'rentals',
         'station_id = ''' || station_id || '''', FALSE, NULL, ['birth_year', 'gender']
  FROM (SELECT DISTINCT station_id FROM rentals)
  UNION ALL
  SELECT 'data_steward', 'steward_filter', 'rentals', 'TRUE', TRUE, NULL, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT 'district_analyst', 'district_filter', 'rentals', 'district = ''{DISTRICT}''', FALSE,
         {names(NO_BIRTH_YEAR)}, NULL
  UNION ALL
  SELECT 'operation', 'operation_filter', 'rentals', 'TRUE', FALSE, {names(NO_PERSONAL)}, NULL
  UNION ALL
  SELECT 'marketing_partner', 'marketing_filter', 'rentals',
         '{MARKETING.replace("'", "''")}', FALSE, {names(NO_BIRTH_YEAR)}, NULL
),
shown AS (
  SELECT *, CASE WHEN include_columns IS NOT NULL THEN include_columns
                 ELSE [x FOR x IN {names(ALL)} IF NOT list_contains(coalesce(exclude_columns, []), x)]
            END AS visible
  FROM policies
),
hiding AS (
  SELECT *, [x FOR x IN {names(ALL)} IF NOT list_contains(visible, x)] AS hidden FROM shown
),
grants AS (
  SELECT role, 'DATABASE' AS resource_type, 'analytics' AS resource, 'DESCRIBE' AS permission
  FROM policies
  UNION ALL SELECT role, 'TABLE', 'rentals', 'DESCRIBE' FROM policies
  UNION ALL SELECT role, 'FILTER', 'rentals/' || name, 'SELECT' FROM policies
  UNION ALL SELECT role, 'LOCATION', 'warehouse/rentals', 'DATA_LOCATION_ACCESS' FROM policies
  UNION ALL SELECT role, 'COLUMNS', 'rentals(' || array_to_string(include_columns, ',') || ')',
                   'SELECT' FROM policies WHERE include_columns IS NOT NULL
),
kept_grants AS (
  SELECT * FROM grants WHERE NOT (resource_type = 'FILTER' AND role LIKE 'analyst%')
)"""


def registry(body: str) -> str:
    return q(body, POLICIES)


def policy_rows(include: str = "include_columns") -> str:
    return (
        f"role, name, \"table\", row_filter, array_to_string({include}, ',') AS include_columns, "
        "array_to_string(exclude_columns, ',') AS exclude_columns"
    )


AUDIT_ROLES = (
    ("data_steward", "TRUE", 11),
    ("district_analyst", f"district = '{DISTRICT}'", 10),
    ("operation", "TRUE", 9),
    ("marketing_partner", MARKETING, 10),
)
AUDIT = "\naudit AS (" + "\nUNION ALL ".join(
    f"SELECT '{role}' AS role, count(*) FILTER (WHERE {p}) AS records, "
    f"CAST({n} AS BIGINT) AS \"columns\", count(DISTINCT district) FILTER (WHERE {p}) AS districts, "
    "count(*) AS table_rows FROM rentals"
    for role, p, n in AUDIT_ROLES
) + ")"

TRAITS = (
    "full_data_access",
    "district_filter",
    "age_filter",
    "personal_info_block",
    "column_restriction",
)
MATRIX = """
matrix AS (
  SELECT role,
         CAST(row_filter = 'TRUE' AS BIGINT) AS full_data_access,
         CAST(row_filter LIKE 'district%' AS BIGINT) AS district_filter,
         CAST(row_filter LIKE '%birth_year%' AS BIGINT) AS age_filter,
         CAST(list_contains(hidden, 'birth_year') OR list_contains(hidden, 'gender') AS BIGINT)
           AS personal_info_block,
         CAST(len(hidden) > 0 AS BIGINT) AS column_restriction
  FROM hiding
)"""

AGE_WITHIN = f"""
ages AS (
  SELECT district, {AGE_GROUP} AS age_group, count(*) AS rentals
  FROM rentals WHERE {VALID} GROUP BY 1, 2
)"""


def kpi(*wanted: str) -> str:
    parts = {
        "rentals": "count(*) AS rentals",
        "stations": "count(DISTINCT station_id) AS stations",
        "active_stations": "count(DISTINCT station_id) FILTER (WHERE usage_min > 0) AS active_stations",
        "station_turnover": "CAST(count(*) AS DOUBLE) / count(DISTINCT station_id)"
        " AS station_turnover",
        "avg_efficiency": "round(avg(CAST(distance_meter AS DOUBLE) / nullif(usage_min, 0)), 4)"
        " AS avg_efficiency",
        "service_coverage": "round(CAST(count(DISTINCT station_id) FILTER (WHERE usage_min > 0)"
        " AS DOUBLE) * 100 / count(DISTINCT station_id), 4) AS service_coverage",
    }
    return f"SELECT {', '.join(parts[w] for w in wanted)} FROM operation"


def age_group_measure(c: str, name: str) -> str:
    kind = "BIGINT" if c == "usage_min" else "DOUBLE"
    return (
        f"SELECT {AGE_GROUP} AS age_group, count(*) AS rentals, {mean(c)} AS avg_{name}, "
        f"CAST(quantile_disc({c}, 0.5) AS {kind}) AS median_{name} "
        f"FROM rentals WHERE {VALID} GROUP BY 1"
    )


KPIS = "rentals stations active_stations station_turnover avg_efficiency service_coverage"

ORACLE: dict[str, str] = {
    # sources, sinks, tables
    "csv_scan": q(f"SELECT {cols(ALL)} FROM csv", CSV),
    "table_scan": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type,"
    " value, props FROM events",
    "create_table": q(f"SELECT {cols(ALL)} FROM stored", CSV, STORED),
    "replace_table": q(f"SELECT {cols(ALL)} FROM stored", CSV, STORED),
    "load_insert": q(
        f"SELECT {cols(ALL)} FROM (SELECT * FROM stored UNION ALL SELECT * FROM stored)", CSV, STORED
    ),
    "load_reconcile": q(
        "SELECT count(*) AS source_rows, count(station_id) AS loaded_rows,"
        " count(*) - count(station_id) AS rejected_rows, CAST(0 AS BIGINT) AS missing_rental_id,"
        " count(*) - count(station_id) AS missing_station_id,"
        " CAST(0 AS BIGINT) AS missing_rental_date, CAST(0 AS BIGINT) AS missing_return_date,"
        " TRUE AS ok FROM csv",
        CSV,
    ),
    "load_staged": q(
        f"SELECT {cols(ALL)} FROM (SELECT * FROM stored UNION ALL SELECT * FROM stored)", CSV, STORED
    ),
    "clustered_scan": q(f"SELECT {cols(NO_BIRTH_YEAR)} FROM analyst"),
    "merge_distinct": q(
        f"SELECT {cols(ALL)} FROM (SELECT *, row_number() OVER (PARTITION BY rental_id ORDER BY usage_min) AS rn"
        " FROM (SELECT * REPLACE (usage_min + 1 AS usage_min) FROM rentals WHERE right(rental_id, 1) <= '4'"
        " UNION ALL SELECT * REPLACE (usage_min + CASE WHEN right(rental_id, 1) IN ('1', '3', '5', '7', '9') THEN 2"
        " ELSE 0 END AS usage_min) FROM rentals WHERE right(rental_id, 1) >= '3')) WHERE rn = 1"
    ),
    "content_reconcile": q(
        "SELECT count(station_id) AS source_rows, count(station_id) AS loaded_rows,"
        " CAST(0 AS BIGINT) AS differing_ranges FROM csv",
        CSV,
    ),
    "schema_report": "SELECT * FROM (VALUES "
    + ", ".join(
        f"(CAST({i} AS BIGINT), '{c}', '"
        + {
            "rental_date": "timestamp_ntz",
            "return_date": "timestamp_ntz",
            "usage_min": "int",
            "distance_meter": "decimal(12,2)",
        }.get(c, "string")
        + "', TRUE)"
        for i, c in enumerate(ALL, start=1)
    )
    + ") t(position, name, type, nullable)",
    "preview": q(f"SELECT {cols(ALL)} FROM (SELECT * FROM rentals ORDER BY rental_id LIMIT 10)"),
    "log_metrics": q(
        "SELECT district AS role, TRUE AS log_available, count(*) AS records,"
        " CAST(10 AS BIGINT) AS \"columns\" FROM rentals WHERE district IS NOT NULL GROUP BY 1"
        " UNION ALL SELECT 'nobody', FALSE, 0, 0"
    ),
    # policies and grants
    "row_filter": q(f"SELECT {cols(ALL)} FROM rentals WHERE district = '{DISTRICT}'"),
    "all_rows": q(f"SELECT {cols(ALL)} FROM rentals"),
    "column_include": q(f"SELECT {cols(NO_PERSONAL)} FROM rentals"),
    "column_exclude": q(f"SELECT {cols(NO_PERSONAL)} FROM rentals"),
    "policy_view": q(f"SELECT {cols(NO_BIRTH_YEAR)} FROM marketing"),
    "policy_upsert": registry(
        "SELECT all_rows, "
        + policy_rows(
            "CASE WHEN name LIKE 'district_filter_%' AND role LIKE 'analyst_%'"
            " THEN [x FOR x IN include_columns IF x <> 'gender'] ELSE include_columns END"
        )
        + " FROM policies"
    ),
    "policy_drop": registry(
        f"SELECT {policy_rows()} FROM policies WHERE name <> 'district_filter_{DISTRICT}'"
    ),
    "policy_log": registry(
        "SELECT all_rows, "
        + policy_rows(
            "CASE WHEN name LIKE 'district_filter_%' AND role LIKE 'analyst_%'"
            " THEN [x FOR x IN include_columns IF x <> 'gender'] ELSE include_columns END"
        )
        + f" FROM policies WHERE name <> 'district_filter_{DISTRICT}'"
    ),
    "grant_log": registry("SELECT * FROM kept_grants"),
    "policy_list": registry(
        "SELECT name, row_filter, CAST(coalesce(len(include_columns), 0) AS BIGINT) AS column_count,"
        " include_columns IS NULL AS has_wildcard FROM policies"
    ),
    "policy_count": registry("SELECT count(*) AS filters FROM policies"),
    "grant": registry("SELECT * FROM grants"),
    "revoke": registry("SELECT * FROM kept_grants"),
    "grant_list": registry("SELECT role, count(*) AS permissions FROM kept_grants GROUP BY role"),
    "default_deny": registry(
        "SELECT role FROM policies WHERE role LIKE 'analyst%' OR role = 'operation'"
    ),
    "role_report_steward": report(
        basics("steward", ALL),
        summaries("steward"),
        [
            long_form("null_counts", "", " ".join(ALL), null_counts(ALL, "steward")),
            long_form("outlier_summary", "", "rentals outliers outlier_pct", outlier_summary("steward", STEWARD_OUT)),
            long_form(
                "outlier_sample",
                "rental_id district",
                "usage_min distance_meter",
                f"SELECT * FROM steward WHERE {STEWARD_OUT} ORDER BY rental_id LIMIT 5",
            ),
        ],
        segments(
            "steward",
            {
                "district_top10": ("district", BOTH),
                "gender_stats": ("gender", "rentals avg_usage"),
                "age_group_stats": ("age_group", BOTH),
                "hourly_counts": ("hour", "rentals"),
            },
            {"district_top10": 10},
        ),
    ),
    "role_report_district": report(
        basics("analyst", NO_BIRTH_YEAR),
        summaries("analyst"),
        [long_form("null_counts", "", " ".join(NO_BIRTH_YEAR), null_counts(NO_BIRTH_YEAR, "analyst"))],
        segments(
            "analyst",
            {
                "station_top10": ("station_id station_name", BOTH),
                "district_stats": ("district", BOTH),
                "gender_stats": ("gender", "rentals avg_usage"),
                "hourly_counts": ("hour", "rentals"),
                "user_type_stats": ("user_type", BOTH),
            },
            {"station_top10": 10},
        ),
    ),
    "role_report_operation": report(
        basics("operation", NO_PERSONAL),
        [
            long_form(f"{name}_quantiles", "", "rentals avg min max p25 p50 p75 p95", summary("operation", c, QUARTILES))
            for name, c in (("usage", "usage_min"), ("distance", "distance_meter"))
        ],
        [
            long_form("kpis", "", KPIS, kpi(*KPIS.split())),
            long_form("outlier_summary", "", "rentals outliers outlier_pct", outlier_summary("operation", OPERATION_OUT)),
            long_form(
                "outlier_top5",
                "rental_id station_name district",
                "usage_min distance_meter",
                f"SELECT * FROM operation WHERE {OPERATION_OUT} ORDER BY usage_min DESC NULLS LAST, rental_id LIMIT 5",
            ),
            long_form(
                "station_efficiency",
                "station_id station_name district first_rental last_rental",
                BOTH,
                grouped("operation", "station_id station_name district", BOTH + " first_rental last_rental", 15),
            ),
        ],
        segments(
            "operation",
            {
                "district_operations": ("district", BOTH + " stations"),
                "hourly_load": ("hour", "rentals avg_usage stations"),
                "user_type_operations": ("user_type", BOTH + " stations"),
                "weekday_operations": ("day_of_week weekday", "rentals avg_usage stations"),
            },
        ),
    ),
    "role_report_marketing": report(
        basics("marketing", NO_BIRTH_YEAR),
        summaries("marketing"),
        [
            long_form(
                "averages",
                "",
                "avg_usage avg_distance",
                f"SELECT {mean('usage_min')} AS avg_usage, {mean('distance_meter')} AS avg_distance FROM marketing",
            )
        ],
        segments(
            "marketing",
            {
                "station_popular": ("station_id station_name", "rentals avg_usage unique_rentals"),
                "district_stats": ("district", BOTH),
                "gender_stats_distance": ("gender", BOTH),
                "hourly_usage": ("hour", "rentals avg_usage"),
                "user_type_operations": ("user_type", BOTH + " stations"),
                "weekday_pattern": ("weekday", "rentals avg_usage"),
                "peak_hour": ("hour", "rentals"),
            },
            {"station_popular": 10, "peak_hour": 1},
        ),
    ),
    # counts
    "row_count": q("SELECT count(*) AS rentals FROM rentals"),
    "distinct_counts": q(distinct_counts("rentals")),
    # results that depend on the engine: the promised bound holds
    "distinct_counts_approx": "SELECT TRUE AS rental_id, TRUE AS station_id, TRUE AS district",
    "distance_quantiles_approx": "SELECT TRUE AS p25, TRUE AS p50, TRUE AS p75, TRUE AS p95",
    "sample_fraction_random": q(
        "SELECT count(*) AS rentals, TRUE AS share_as_asked, TRUE AS rows_of_the_table FROM rentals"
    ),
    "distinct_counts_scoped": q(distinct_counts("marketing")),
    "distinct_sketches_roles": q(
        "\nUNION ALL ".join(
            f"SELECT '{role}' AS role, count(*) AS rentals, TRUE AS rental_id, TRUE AS station_id, TRUE AS district FROM {table}"
            for role, table in (
                ("data_steward", "steward"),
                ("district_analyst", "analyst"),
                ("operation", "operation"),
                ("marketing_partner", "marketing"),
            )
        )
    ),
    "count_distinct_in_group": q(
        "SELECT user_type, count(DISTINCT district) AS distinct_values FROM rentals GROUP BY 1"
    ),
    # grouped reports
    "district_top10": q(grouped("steward", "district", BOTH, 10)),
    "district_stats": q(grouped("analyst", "district", BOTH)),
    "district_operations": q(grouped("operation", "district", BOTH + " stations")),
    "gender_stats": q(grouped("steward", "gender", "rentals avg_usage")),
    "gender_stats_distance": q(grouped("marketing", "gender", BOTH)),
    "age_group_stats": q(grouped("steward", "age_group", BOTH)),
    "station_top10": q(grouped("analyst", "station_id station_name", BOTH, 10)),
    "station_popular": q(
        grouped("marketing", "station_id station_name", "rentals avg_usage unique_rentals", 10)
    ),
    "station_efficiency": q(
        grouped(
            "operation", "station_id station_name district", BOTH + " first_rental last_rental", 15
        )
    ),
    "hourly_counts": q(grouped("steward", "hour", "rentals")),
    "hourly_usage": q(grouped("marketing", "hour", "rentals avg_usage")),
    "hourly_load": q(grouped("operation", "hour", "rentals avg_usage stations")),
    "weekday_operations": q(
        grouped("operation", "day_of_week weekday", "rentals avg_usage stations")
    ),
    "weekday_pattern": q(grouped("marketing", "weekday", "rentals avg_usage")),
    "user_type_stats": q(grouped("analyst", "user_type", BOTH)),
    "user_type_operations": q(grouped("operation", "user_type", BOTH + " stations")),
    "peak_hour": q(grouped("marketing", "hour", "rentals", 1)),
    # summaries and quantiles
    "usage_summary": q(summary("rentals", "usage_min", MEDIAN)),
    "distance_summary": q(summary("rentals", "distance_meter", MEDIAN)),
    "usage_quantiles": q(summary("operation", "usage_min", QUARTILES)),
    "distance_quantiles": q(summary("operation", "distance_meter", QUARTILES)),
    "avg_usage": q(f"SELECT {mean('usage_min')} AS avg_usage FROM marketing"),
    "avg_distance": q(f"SELECT {mean('distance_meter')} AS avg_distance FROM marketing"),
    # operating ratios
    "station_turnover": q(kpi("station_turnover")),
    "avg_efficiency": q(kpi("avg_efficiency")),
    "service_coverage": q(kpi("service_coverage")),
    "kpis": q(
        kpi(
            "rentals",
            "stations",
            "active_stations",
            "station_turnover",
            "avg_efficiency",
            "service_coverage",
        )
    ),
    # predicates and expressions
    "outliers": q(f"SELECT {cols(ALL)} FROM steward WHERE {STEWARD_OUT}"),
    "outlier_summary": q(outlier_summary("steward", STEWARD_OUT)),
    "outlier_sample": q(
        f"SELECT {cols(['rental_id', 'usage_min', 'distance_meter', 'district'])} FROM "
        f"(SELECT * FROM steward WHERE {STEWARD_OUT} ORDER BY rental_id LIMIT 5)"
    ),
    "operational_outliers": q(f"SELECT {cols(NO_PERSONAL)} FROM operation WHERE {OPERATION_OUT}"),
    "operational_outlier_summary": q(outlier_summary("operation", OPERATION_OUT)),
    "operational_outlier_top5": q(
        "SELECT "
        + cols(["rental_id", "station_name", "usage_min", "distance_meter", "district"])
        + f" FROM (SELECT * FROM operation WHERE {OPERATION_OUT}"
        " ORDER BY usage_min DESC NULLS LAST, rental_id LIMIT 5)"
    ),
    "age_group": q(f"SELECT rental_id, {AGE_GROUP} AS age_group FROM rentals"),
    "hour_of_day": q(f"SELECT rental_id, {HOUR} AS hour FROM rentals"),
    "weekday_name": q("SELECT rental_id, dayname(rental_date) AS weekday FROM rentals"),
    "day_of_week": q(f"SELECT rental_id, {DOW} AS day_of_week FROM rentals"),
    "active_filter": q(f"SELECT {cols(['rental_id', 'usage_min'])} FROM rentals WHERE usage_min > 0"),
    "not_null_keys": q(
        "SELECT rental_id FROM rentals WHERE birth_year IS NOT NULL AND gender IS NOT NULL"
        " AND district IS NOT NULL"
    ),
    # quality and preparation
    "null_counts": q(null_counts(ALL, "rentals")),
    "null_counts_scoped": q(null_counts(NO_BIRTH_YEAR, "analyst")),
    "missing_profile": q(profile()),
    "sentinel_filter": q(
        "SELECT rental_id, birth_year FROM rentals WHERE birth_year IS DISTINCT FROM 'N'"
        " AND gender IS DISTINCT FROM 'N' AND user_type IS DISTINCT FROM 'N'"
        " AND station_id IS DISTINCT FROM 'N'"
    ),
    "sample_fraction": q(
        f"SELECT rental_id FROM rentals WHERE substr(md5(rental_id), 1, 15) < '{SAMPLE_CUT}'"
    ),
    "sample_exact": q(
        f"SELECT {cols(ALL)} FROM (SELECT * FROM rentals ORDER BY md5(rental_id) LIMIT 500)"
    ),
    "duplicate_keys": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,"
    " count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dedupe": "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,"
    " l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,"
    " strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM (SELECT *, row_number() OVER ("
    "PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity,"
    " l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)"
    " WHERE rn = 1",
    "invalid_dates": q(
        "SELECT rental_id, 'x' || strftime(rental_date, '%Y-%m-%d %H:%M:%S') AS rental_date"
        " FROM rentals WHERE substr(md5(rental_id), 1, 1) = '0'"
    ),
    "negative_duration": q(
        "SELECT rental_id, strftime(return_date, '%Y-%m-%d %H:%M:%S.%f') AS rental_date,"
        " strftime(rental_date, '%Y-%m-%d %H:%M:%S.%f') AS return_date FROM rentals"
        " WHERE user_type = 'new' AND return_date > rental_date"
    ),
    "valid_age": q(f"SELECT rental_id, birth_year FROM rentals WHERE {VALID}"),
    "numeric_casts": q(
        "SELECT rental_id, CAST(usage_min AS BIGINT) AS usage_min_numeric,"
        " CAST(distance_meter AS DOUBLE) AS distance_numeric,"
        f" CAST({YEAR} AS BIGINT) AS birth_year_numeric FROM rentals"
    ),
    # documented analyses
    "district_age": q(
        f"SELECT district, CAST({AS_OF_YEAR} - {YEAR} AS BIGINT) AS age, count(*) AS rentals,"
        f" {mean('usage_min')} AS avg_usage, {mean('distance_meter')} AS avg_distance FROM steward"
        " GROUP BY 1, 2 ORDER BY rentals DESC, district NULLS FIRST, age NULLS FIRST LIMIT 20"
    ),
    "station_gender": q(grouped("analyst", "station_name gender", BOTH)),
    "district_station_hour": q(
        grouped("operation", "district station_name rental_hour", "rentals avg_usage", 50)
    ),
    "station_gender_day": q(
        grouped("marketing", "station_name gender rental_day", "rentals avg_distance")
    ),
    "district_share": q(share("rentals", "district", limit=10)),
    "gender_share": q(share("rentals", "gender")),
    "user_type_share": q(share("rentals", "user_type")),
    "age_share": q(share("rentals", "age_group", where=VALID)),
    "district_age_share": q(
        "SELECT district, age_group, rentals, CAST(n AS BIGINT) AS district_rentals,"
        " round(CAST(rentals AS DOUBLE) * 100 / n, 2) AS pct FROM ages JOIN"
        " (SELECT district, sum(rentals) AS n FROM ages WHERE district IS NOT NULL GROUP BY 1"
        " ORDER BY n DESC, district LIMIT 5) USING (district)",
        AGE_WITHIN,
    ),
    "dominant_age": q(
        "SELECT district, age_group, rentals, round(CAST(rentals AS DOUBLE) * 100 / n, 2) AS pct"
        " FROM (SELECT *, sum(rentals) OVER (PARTITION BY district) AS n, row_number() OVER"
        " (PARTITION BY district ORDER BY rentals DESC, age_group) AS rn FROM ages) WHERE rn = 1",
        AGE_WITHIN,
    ),
    "segment_lift": q(
        "SELECT district, age_group, rentals, round(inside * 100, 2) AS pct_within,"
        " round(outside * 100, 2) AS pct_overall, round(inside / outside, 4) AS lift FROM ("
        "SELECT *, CAST(rentals AS DOUBLE) / sum(rentals) OVER (PARTITION BY district) AS inside,"
        " CAST(sum(rentals) OVER (PARTITION BY age_group) AS DOUBLE) / sum(rentals) OVER ()"
        " AS outside FROM ages)",
        AGE_WITHIN,
    ),
    "gender_age_crosstab": q(
        f"SELECT {AGE_GROUP} AS age_group, count(*) FILTER (WHERE gender = 'M') AS male,"
        " count(*) FILTER (WHERE gender = 'F') AS female,"
        " count(*) FILTER (WHERE gender IS NULL) AS missing, count(*) AS total,"
        " round(CAST(count(*) FILTER (WHERE gender = 'M') AS DOUBLE) * 100"
        " / nullif(count(*) FILTER (WHERE gender IN ('M', 'F')), 0), 2) AS male_pct"
        f" FROM rentals WHERE {VALID} GROUP BY 1"
    ),
    "age_stats": q(
        f"SELECT count(*) AS rentals, CAST(sum(age) AS DOUBLE) / count(*) AS avg_age,"
        " CAST(median(age) AS DOUBLE) AS median_age, min(age) AS min_age, max(age) AS max_age,"
        " round(stddev_samp(age), 6) AS stddev_age FROM"
        f" (SELECT CAST({AS_OF_YEAR} - {YEAR} AS BIGINT) AS age FROM rentals WHERE {VALID})"
    ),
    "top_birth_years": q(
        f"SELECT *, CAST({AS_OF_YEAR} - birth_year AS BIGINT) AS age FROM (SELECT birth_year, rentals,"
        " round(CAST(rentals AS DOUBLE) * 100 / sum(rentals) OVER (), 2) AS pct FROM"
        f" (SELECT CAST({YEAR} AS BIGINT) AS birth_year, count(*) AS rentals FROM rentals"
        f" WHERE {VALID} GROUP BY 1)) ORDER BY rentals DESC, birth_year LIMIT 5"
    ),
    "age_group_usage": q(age_group_measure("usage_min", "usage")),
    "age_group_distance": q(age_group_measure("distance_meter", "distance")),
    "time_band": q(grouped("rentals", "time_band", "rentals")),
    # access audit
    "access_audit": q("SELECT * FROM audit", AUDIT),
    "access_ratio": q(
        "SELECT role, records, round(CAST(records AS DOUBLE) * 100 / table_rows, 1) AS access_pct,"
        " round(CAST(records AS DOUBLE) * 100 / table_rows, 2) AS access_pct_2 FROM audit",
        AUDIT,
    ),
    "districts_per_role": q("SELECT role, districts FROM audit", AUDIT),
    "access_audit_registry": q(
        "SELECT * FROM audit UNION ALL SELECT 'analyst_' || district, count(*), CAST(10 AS BIGINT), CAST(1 AS BIGINT),"
        " (SELECT count(*) FROM rentals) FROM rentals WHERE district IS NOT NULL GROUP BY district"
        " UNION ALL SELECT 'operator_' || station_id, count(*), CAST(9 AS BIGINT), count(DISTINCT district),"
        " (SELECT count(*) FROM rentals) FROM rentals GROUP BY station_id",
        AUDIT,
    ),
    "filter_kind_counts": registry(
        "SELECT CASE WHEN row_filter = 'TRUE' AND len(hidden) = 0 THEN 'none'"
        " WHEN row_filter = 'TRUE' THEN 'column' WHEN row_filter LIKE '%AND%' THEN 'multi'"
        " WHEN row_filter LIKE 'district = %' THEN 'district' ELSE 'row' END AS filter_kind,"
        " count(*) AS roles FROM hiding GROUP BY 1"
    ),
    "permission_matrix": q("SELECT * FROM matrix", POLICIES, MATRIX),
    "permission_matrix_long": q(
        "\nUNION ALL ".join(
            f"SELECT role, '{t}' AS trait, {t} AS applied FROM matrix" for t in TRAITS
        ),
        POLICIES,
        MATRIX,
    ),
    "column_block_rate": registry(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\","
            f" count(*) FILTER (WHERE list_contains(hidden, '{c}')) AS blocked_roles,"
            f" round(CAST(count(*) FILTER (WHERE list_contains(hidden, '{c}')) AS DOUBLE) * 100"
            " / count(*), 2) AS block_pct FROM hiding"
            for c in ALL
        )
    ),
    "hidden_columns": registry(
        "SELECT role, CAST(len(hidden) AS BIGINT) AS hidden_count,"
        " array_to_string(hidden, ',') AS hidden_columns FROM hiding"
    ),
}

# the same results by another way
for _name in ("station_top10", "station_popular", "district_station_hour"):
    ORACLE[f"{_name}_heavy"] = ORACLE[_name]
