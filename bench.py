"""Time the headline queries; prints one JSON line.

All queries run once untimed (class loading, code generation) and then in two timed rounds; the
better time counts. Results go to Spark's no-op sink, so every output row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolelens.catalog.queries import QUERIES  # noqa: E402
from rolelens.session import local_session  # noqa: E402

HEADLINE = (
    "district_top10",
    "district_operations",
    "age_group_stats",
    "station_efficiency",
    "station_popular",
    "hourly_load",
    "weekday_operations",
    "distinct_counts",
    "usage_quantiles",
    "distance_quantiles",
    "age_group_distance",
    "kpis",
    "operational_outlier_summary",
    "missing_profile",
    "district_age_share",
    "segment_lift",
    "gender_age_crosstab",
    "sample_exact",
    "dedupe",
    "access_audit",
    "permission_matrix",
    "load_reconcile",
    "role_report_steward",
    "role_report_district",
    "role_report_operation",
    "role_report_marketing",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    spark = local_session(cpus, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(spark, name, sf_dir)
    rounds = [{name: run(spark, name, sf_dir) for name in names} for _ in range(2)]
    times = {name: round(min(r[name] for r in rounds), 4) for name in names}
    spark.stop()
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
