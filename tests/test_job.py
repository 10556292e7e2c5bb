"""The report job end to end: stored table in, printed report out, counts read back from the log."""

import pytest
from rows import rental, table

from rolelens.operators import policy as P
from rolelens.plans import job
from rolelens.sources.logs import log_metrics


@pytest.fixture
def stored(spark, tmp_path):
    rows = [rental(i, district="AB"[i % 2], birth_year=str(1990 + i)) for i in range(12)]
    registry = P.policy_registry(spark, P.standard_policies("A"))
    paths = {name: str(tmp_path / name) for name in ("rentals", "registry", "grants")}
    table(spark, *rows).write.parquet(paths["rentals"])
    registry.write.parquet(paths["registry"])
    P.role_grants(registry).where("role <> 'operation' OR resource_type <> 'FILTER'").write.parquet(paths["grants"])
    return ["--table", paths["rentals"], "--registry", paths["registry"], "--grants", paths["grants"]]


def test_job_prints_a_log_that_log_metrics_reads(spark, stored, tmp_path, capsys):
    folder = tmp_path / "logs" / "role=marketing_partner"
    folder.mkdir(parents=True)
    capsys.readouterr()
    job.main([*stored, "--role", "marketing_partner"])
    out = capsys.readouterr().out
    (folder / "stdout").write_text(out, encoding="utf-8")
    got = log_metrics(spark, str(tmp_path / "logs")).first()
    assert (got.role, got.records, got.columns) == ("marketing_partner", 4, 10)
    assert "== station_popular" in out and "birth_year" not in out


def test_job_refuses_a_role_without_its_grant(stored):
    with pytest.raises(PermissionError):
        job.main([*stored, "--role", "operation"])
