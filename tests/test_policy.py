"""Policies: rows and columns per role, no leaks, default deny, registry and grants."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from rows import rental, table, values

from rolelens.operators import audit as A
from rolelens.operators import filters
from rolelens.operators import policy as P
from rolelens.operators import segment as G
from rolelens.plans import reports as R
from rolelens.schema import RENTAL_COLUMNS, HiddenColumnError

YEARS = ("1994", "2004", "2004.0", "1993", "", None, "N", "2000")


@pytest.fixture(scope="module")
def rentals(spark):
    rows = [rental(i, birth_year=y) for i, y in enumerate(YEARS)]
    rows += [rental(20, district="B"), rental(21, district=None)]
    return table(spark, *rows).cache()


@pytest.fixture(scope="module")
def policies():
    return P.standard_policies("A")


def ids(df):
    return {r.rental_id for r in df.collect()}


def test_rows_and_columns_per_role(rentals, policies):
    steward = P.policy_view(rentals, policies, P.STEWARD)
    analyst = P.policy_view(rentals, policies, P.DISTRICT_ANALYST)
    operation = P.policy_view(rentals, policies, P.OPERATION)
    marketing = P.policy_view(rentals, policies, P.MARKETING_PARTNER)
    assert steward.count() == 10 and steward.columns == list(RENTAL_COLUMNS)
    assert ids(analyst) == {f"r{i}" for i in range(8)} and len(analyst.columns) == 10
    assert operation.count() == 10 and len(operation.columns) == 9
    # The years compare as text: "2004.0" and "N" sort after "2004", "" and NULL fail.
    assert ids(marketing) == {"r0", "r1", "r7"} and "birth_year" not in marketing.columns


@pytest.mark.parametrize("view", [None, "scoped_view"])
def test_hidden_columns_do_not_leak(rentals, policies, view):
    scoped = P.policy_view(rentals, policies, P.MARKETING_PARTNER, view=view)
    attempts = (
        lambda: scoped.filter("birth_year > '1995'"),
        lambda: scoped.orderBy("birth_year"),
        lambda: scoped.select("birth_year"),
        lambda: scoped.select(rentals["birth_year"]),
        lambda: scoped.withColumn("y", F.col("birth_year")),
        lambda: scoped.groupBy("birth_year").count(),
    )
    for attempt in attempts:
        with pytest.raises(AnalysisException):
            attempt().collect()


def test_where_select_alone_would_leak(rentals):
    """The reason for the alias: if Spark changes this, it can go."""
    leaky = rentals.select("rental_id")
    assert leaky.filter("birth_year = '1994'").count() == 1


def test_user_filter_sees_visible_rows_only(spark, rentals, policies):
    scoped = P.policy_view(rentals, policies, P.DISTRICT_ANALYST)
    check = F.when(F.col("district") != "A", F.raise_error(F.lit("hidden row"))).otherwise(True)
    assert scoped.filter(check.cast("boolean")).count() == 8


def test_default_deny(rentals, policies):
    with pytest.raises(PermissionError):
        P.policy_view(rentals, policies, "nobody")
    with pytest.raises(PermissionError):
        P.policy_view(rentals, policies, P.STEWARD, table="other")
    with pytest.raises(PermissionError):
        P.policy_view(rentals, [], P.STEWARD)
    with pytest.raises(PermissionError):
        R.role_report(rentals, "nobody")


def test_two_filters_for_one_role_are_an_error(rentals, policies):
    second = P.Policy(P.OPERATION, "second", all_rows=True)
    with pytest.raises(ValueError):
        P.policy_view(rentals, [*policies, second], P.OPERATION)


def test_operator_on_hidden_column_says_so(rentals, policies):
    operation = P.policy_view(rentals, policies, P.OPERATION)
    with pytest.raises(HiddenColumnError, match="gender"):
        G.segment(operation, "gender_stats")
    with pytest.raises(HiddenColumnError, match="birth_year"):
        G.segment(operation, "age_group_stats")


def test_adding_a_condition_never_adds_rows(rentals):
    wide = P.Policy("r", "wide", row_filter="district = 'A'")
    narrow = P.Policy("r", "narrow", row_filter="district = 'A' AND birth_year > '1994'")
    assert ids(P.row_filter(rentals, narrow)) <= ids(P.row_filter(rentals, wide)) <= ids(rentals)


def test_validate(rentals):
    ok = P.Policy("r", "ok", row_filter="district = 'A' OR usage_min > 3")
    assert P.validate(ok, rentals) is ok
    for text in (
        "no_such_column = 1",
        "district",
        "district IN (SELECT 'A')",
        "EXISTS (SELECT 1)",
        "district =",
        "count(*) > 1",
    ):
        with pytest.raises(AnalysisException):
            P.validate(P.Policy("r", "bad", row_filter=text), rentals)
    with pytest.raises(HiddenColumnError):
        P.validate(P.Policy("r", "bad", all_rows=True, include_columns=["nope"]), rentals)
    with pytest.raises(ValueError):
        P.Policy("r", "bad")
    with pytest.raises(ValueError):
        P.Policy("r", "bad", all_rows=True, include_columns=["a"], exclude_columns=["b"])


def test_equals_filter_quotes(spark):
    df = spark.createDataFrame([("a'b",), ("a\\b",), ("' OR TRUE --",), ("x",)], "district string")
    for v in ("a'b", "a\\b", "' OR TRUE --"):
        assert values(df.where(P.equals_filter("district", v)), "district") == [(v,)]


def test_upsert_twice_is_one_policy(spark, policies):
    registry = P.policy_registry(spark, policies)
    changed = P.policy_registry(
        spark, [P.Policy(P.OPERATION, "operation_filter", row_filter="usage_min > 0")]
    )
    once = P.policy_upsert(registry, changed)
    twice = P.policy_upsert(once, changed)
    assert P.policy_count(twice, P.TABLE).first().filters == 4
    assert values(twice.where("name = 'operation_filter'"), "row_filter") == [("usage_min > 0",)]
    dropped = P.policy_drop(twice, P.TABLE, "operation_filter")
    assert P.policy_count(dropped, P.TABLE).first().filters == 3
    assert P.policy_drop(dropped, "other", "steward_filter").count() == 3


def test_policy_list(spark, policies):
    listed = {r.name: (r.column_count, r.has_wildcard) for r in P.policy_list(P.policy_registry(spark, policies)).collect()}
    assert listed == {
        "steward_filter": (0, True),
        "district_filter": (10, False),
        "operation_filter": (9, False),
        "marketing_filter": (10, False),
    }


def test_grants(spark, policies):
    grants = P.role_grants(P.policy_registry(spark, policies))
    assert P.grant(grants, grants).count() == grants.count() == 19
    gone = grants.where("role = 'operation' AND permission = 'SELECT'")
    left = P.revoke(grants, gone)
    assert dict(values(P.grant_list(left), "role", "permissions"))["operation"] == 3
    assert P.revoke(left, gone).count() == 17
    assert P.grant_list(left, "operation").count() == 1


def test_audit_agrees_with_the_views(rentals, policies):
    audit = {r.role: r for r in A.access_audit(rentals, policies).collect()}
    for p in policies:
        scoped = P.policy_view(rentals, policies, p.role)
        assert audit[p.role].records == scoped.count()
        assert audit[p.role].columns == len(scoped.columns)
        assert audit[p.role].districts == scoped.where("district IS NOT NULL").select("district").distinct().count()
        assert audit[p.role].table_rows == rentals.count()


def test_audit_of_an_empty_table(rentals, policies):
    rows = A.access_ratio(A.access_audit(rentals.limit(0), policies)).collect()
    assert len(rows) == 4 and all(r.records == 0 and r.access_pct is None for r in rows)


def test_matrix_kinds_and_block_rates(spark, policies):
    registry = P.policy_registry(spark, policies)
    matrix = {r.role: tuple(r)[1:] for r in A.permission_matrix(registry).collect()}
    assert matrix == {
        P.STEWARD: (1, 0, 0, 0, 0),
        P.DISTRICT_ANALYST: (0, 1, 0, 1, 1),
        P.OPERATION: (1, 0, 0, 1, 1),
        P.MARKETING_PARTNER: (0, 1, 1, 1, 1),
    }
    kinds = dict(values(A.filter_kind_counts(registry), "filter_kind", "roles"))
    assert kinds == {"none": 1, "district": 1, "column": 1, "multi": 1}
    rates = dict(values(A.column_block_rate(registry), "column", "block_pct"))
    assert rates["birth_year"] == 75.0 and rates["gender"] == 25.0 and rates["district"] == 0.0
    hidden = dict(values(A.hidden_columns(registry), "role", "hidden_columns"))
    assert hidden[P.STEWARD] == [] and hidden[P.OPERATION] == ["birth_year", "gender"]


def test_quoted_values_are_not_column_mentions(spark):
    tricky = P.Policy("r", "n", row_filter="station_id = 'district birth_year \\' gender'")
    registry = P.policy_registry(spark, [tricky])
    assert A.filter_kinds(registry).first().filter_kind == "row"
    assert A.permission_matrix(registry).first().age_filter == 0


def test_open_table_needs_filter_and_grant(spark, rentals, policies):
    registry = P.policy_registry(spark, policies, rentals)
    grants = P.role_grants(registry)
    opened = P.open_table(rentals, registry, grants, P.MARKETING_PARTNER)
    assert ids(opened) == {"r0", "r1", "r7"} and len(opened.columns) == 10
    for weak in ("permission = 'DESCRIBE'", "resource_type <> 'FILTER'"):
        with pytest.raises(PermissionError):
            P.open_table(rentals, registry, grants.where(weak), P.OPERATION)
    with pytest.raises(PermissionError):
        P.open_table(rentals, P.policy_drop(registry, P.TABLE, "steward_filter"), grants, P.STEWARD)
    roles = spark.createDataFrame([(p.role,) for p in policies] + [("nobody",)], "role string")
    left = P.policy_drop(registry, P.TABLE, "steward_filter")
    granted = grants.where("NOT (role = 'operation' AND resource_type = 'FILTER')")
    denied = {r.role for r in P.denied_roles(roles, left, granted).collect()}
    assert denied == {"nobody", P.STEWARD, P.OPERATION}
    with pytest.raises(AnalysisException):
        P.policy_registry(spark, [P.Policy("r", "bad", row_filter="no_such = 1")], rentals)


def test_filter_grants_name_their_table(spark, rentals):
    both = [P.Policy("x", "f", "rentals", all_rows=True), P.Policy("x", "f", "salaries", all_rows=True)]
    registry = P.policy_registry(spark, both)
    grants = P.role_grants(registry.where("table = 'rentals'"))
    roles = spark.createDataFrame([("x",)], "role string")
    assert P.open_table(rentals, registry, grants, "x").count() == rentals.count()
    with pytest.raises(PermissionError):
        P.open_table(rentals, registry, grants, "x", "salaries")
    assert P.denied_roles(roles, registry, grants).count() == 0
    assert values(P.denied_roles(roles, registry, grants, "salaries"), "role") == [("x",)]


def test_two_filters_are_denied_as_they_are_refused(spark, rentals):
    two = P.policy_registry(spark, [P.Policy("x", n, all_rows=True) for n in ("f", "g")])
    grants = P.role_grants(two)
    with pytest.raises(ValueError):
        P.open_table(rentals, two, grants, "x")
    assert values(P.denied_roles(two.select("role"), two, grants), "role") == [("x",)]


def test_stored_filters_are_checked_when_used(spark, rentals):
    spark.range(3).createOrReplaceTempView("secret")
    bad = P.policy_registry(spark, [P.Policy("x", "f", row_filter="1 IN (SELECT id FROM secret)")])
    with pytest.raises(AnalysisException):
        P.open_table(rentals, bad, P.role_grants(bad), "x")
    fine = P.Policy("x", "f", row_filter="district = '(SELECT' OR district = \"(select\" /* ( select */")
    assert P.validate(fine, rentals) is fine


def test_filters_mention_columns_in_any_form(spark):
    texts = {
        "DISTRICT = 'A'": "district",
        "`district` = 'A'": "district",
        'gender = "district"': "row",
        "District = 'A' AND GENDER = 'F'": "multi",
    }
    registry = P.policy_registry(spark, [P.Policy(t, "f", row_filter=t) for t in texts])
    assert dict(values(A.filter_kinds(registry), "role", "filter_kind")) == texts


def test_no_filter_and_no_request_for_all_rows_is_no_access(spark):
    registry = P.policy_registry(spark, [P.Policy("x", "f", all_rows=True)]).withColumn("all_rows", F.lit(False))
    assert A.filter_kinds(registry).first().filter_kind == "invalid"
    assert A.permission_matrix(registry).first().full_data_access == 0
    with pytest.raises(ValueError):
        P.role_policies(registry, "x")


def test_upsert_of_one_name_twice_at_once(spark, policies):
    new = [P.Policy("b", "same", row_filter="usage_min > 1"), P.Policy("a", "same", row_filter="usage_min > 2")]
    out = P.policy_upsert(P.policy_registry(spark, policies), P.policy_registry(spark, new))
    assert values(out.where("name = 'same'"), "role") == [("a",)] and out.count() == 5


def test_derived_filters_are_quoted(spark):
    df = spark.createDataFrame([("O'NATION",), ("a\\b",), ("plain",)], "district string")
    for text, value in values(df.select(P.equals_filters("district", F.col("district")).alias("f"), "district"), "f", "district"):
        assert text == P.equals_filter("district", value) and values(df.where(text), "district") == [(value,)]


BYPASSES = (
    r"district = r'\' OR 1 IN (SELECT id FROM secret) OR 'a' = 'b'",
    "district = 'A' /* /* */ ' */ OR 1 IN (SELECT id FROM secret) /* ' */",
    "EXISTS (SELECT 1 FROM secret)",
    "(SELECT max(id) FROM secret) = 2",
    "sum(usage_min) OVER () > 1",
    "exists(array(1), x -> x > 1)",
    "reflect('java.lang.System', 'getenv', 'HOME') = 'x'",
    "raise_error('x') IS NULL",
    "rand() < 0.5",
    "current_user() = 'x'",
    ":p = 1",
)


@pytest.mark.parametrize("text", BYPASSES)
def test_filters_of_other_than_listed_expressions_are_refused(spark, rentals, text):
    spark.range(3).createOrReplaceTempView("secret")
    policy = P.Policy("x", "f", row_filter=text)
    with pytest.raises(AnalysisException):
        P.policy_view(rentals, [policy], "x")
    registry = P.policy_registry(spark, [policy])
    assert A.filter_kinds(registry).first().filter_kind == "invalid"
    assert values(A.access_audit(rentals, registry), "records", "districts") == [(0, 0)]


def test_usual_filters_pass(spark, rentals, policies):
    for text in (
        "lower(district) LIKE 'a%' AND usage_min BETWEEN 1 AND 9 OR NOT (gender IS NULL)",
        "district IN ('A', 'B') AND CASE WHEN usage_min > 3 THEN TRUE ELSE FALSE END",
        "year(rental_date) = 2024 AND extract(HOUR FROM rental_date) >= 6 AND distance_meter / 2 > -1",
        "station_id || district <=> 's1A' AND cast(usage_min AS string) RLIKE '6' AND substring(gender, 1, 1) = 'F'",
'district = r\'\\\' OR district = "--(SELECT 1)"',
    ):
        assert P.policy_view(rentals, [P.Policy("x", "f", row_filter=text)], "x").count() >= 0, text
    assert len(P.policy_registry(spark, policies, rentals).collect()) == 4


def test_columns_come_from_the_tree(spark):
    texts = {
        r"district = r'\' OR rental_id = 'x'": ["district", "rental_id"],
        "district = 'A' /* gender = birth_year */ -- gender": ["district"],
        "`district` = 'gender'": ["district"],
        "TRUE": [],
    }
    registry = P.policy_registry(spark, [P.Policy(t, t, row_filter=t) for t in texts])
    index = filters.indexed(registry)
    assert dict(values(index, "role", "filter_columns")) == texts
    kinds = dict(values(A.filter_kinds(registry), "role", "filter_kind"))
    assert list(kinds[t] for t in texts) == ["multi", "district", "district", "none"]
    assert filters.indexed(index) is index


def test_filters_split_into_equalities_and_the_rest(spark):
    def parts(text):
        found = filters.read(spark, text)
        return found.equals, found.rest

    assert parts("District = 'A' AND 'B' = gender") == ((("district", "A"), ("gender", "B")), None)
    assert parts("district = 'A' AND usage_min > 1") == ((("district", "A"),), "((usage_min > 1))")
    assert parts("district = 'A' AND district = 'B'")[0] == (("district", "A"),)
    assert parts("district = 'A' OR gender = 'B'") == ((), "district = 'A' OR gender = 'B'")
    assert parts("usage_min = 5 AND NOT district = 'A'")[0] == ()
    assert parts(P.equals_filter("district", "O'N\\x")) == ((("district", "O'N\\x"),), None)


def test_grants_of_filters_are_not_ambiguous(spark, rentals):
    both = [P.Policy("x", "f", "a/b", all_rows=True), P.Policy("x", "b/f", "a", all_rows=True), P.Policy("x", "f", "a\\/b", all_rows=True)]
    registry = P.policy_registry(spark, both)
    for own, table in (("f", "a/b"), ("b/f", "a"), ("f", "a\\/b")):
        grants = P.role_grants(registry.where((F.col("name") == own) & (F.col("table") == table)))
        for p in both:
            if (p.name, p.table) == (own, table):
                assert P.open_table(rentals, registry, grants, "x", p.table).count() == rentals.count()
            else:
                with pytest.raises(PermissionError):
                    P.open_table(rentals, registry, grants, "x", p.table)


def many_policies():
    out = [P.Policy(f"s{i}", f"f{i}", row_filter=f"station_id = 's{i % 7}'") for i in range(20)]
    out += [P.Policy(f"d{i}", f"g{i}", row_filter=f"district = 'A' AND birth_year >= '{1990 + i}'") for i in range(9)]
    out += [P.Policy(f"m{i}", f"h{i}", row_filter=f"'B' = District and gender = 'F' AND usage_min > {i}") for i in range(3)]
    out += [P.Policy("or", "i", row_filter="district = 'A' OR district IS NULL"), P.Policy("all", "j", row_filter="TRUE")]
    out += [P.Policy("never", "k", row_filter="district = 'nowhere'"), P.Policy("both", "l", row_filter="district = 'A' AND district = 'B'")]
    out += [P.Policy("every", "m", all_rows=True, exclude_columns=["gender"])]
    return out + [P.Policy("number", "n", row_filter="usage_min = '6'"), P.Policy("only", "o", row_filter="usage_min > 5")]


@pytest.mark.parametrize("at_once", [200, 4])
def test_audit_by_index_agrees_with_the_views(spark, rentals, monkeypatch, at_once):
    monkeypatch.setattr(A, "EXPRESSIONS", at_once)
    rows = [rental(i, station_id=f"s{i % 4}", district=[None, "A", "B"][i % 3], usage_min=i % 9, gender="MF"[i % 2]) for i in range(30, 90)]
    data = rentals.unionByName(table(spark, *rows)).cache()
    policies = many_policies()
    registry = P.policy_registry(spark, policies)
    for audit in (A.access_audit(data, policies), A.access_audit(data, registry)):
        found = {r.role: r for r in audit.collect()}
        assert len(found) == len(policies)
        for p in policies:
            scoped = P.policy_view(data, policies, p.role)
            one = found[p.role]
            assert (one.records, one.columns, one.table_rows) == (scoped.count(), len(scoped.columns), 70), p
            assert one.districts == scoped.where("district IS NOT NULL").select("district").distinct().count(), p
    empty = A.access_audit(data.limit(0), policies).collect()
    assert len(empty) == len(policies) and all((r.records, r.table_rows) == (0, 0) for r in empty)


def test_audit_of_many_policies_reads_the_table_once(spark, rentals):
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    watched = rentals.where(seen.asNondeterministic()("rental_id"))
    A.access_audit(watched, many_policies()).collect()
    assert read.value == rentals.count()
