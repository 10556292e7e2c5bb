"""One role's report as a Spark job.

    python -m rolelens.plans.job --table <name or path> --role operation \\
        --registry <policies> --grants <grants>

The role's one filter has to be in the registry and granted to it; otherwise the job is refused.
Prints the record count and the schema in the form ``log_metrics`` reads, then every table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rolelens.operators import policy as P
from rolelens.plans.reports import REPORTS, role_report, show_report
from rolelens.sources.load import table_scan
from rolelens.sources.logs import RECORD_LINE


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--table", required=True, help="catalog table or Parquet path")
    parser.add_argument("--role", required=True, choices=sorted(REPORTS))
    parser.add_argument("--registry", required=True, help="policy table or Parquet path")
    parser.add_argument("--grants", required=True, help="grant table or Parquet path")
    parser.add_argument("--name", default=P.TABLE, help="the table's name in registry and grants")
    parser.add_argument("--rows", type=int, default=20, help="rows printed per table")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"report-{args.role}").getOrCreate()
    table = table_scan(spark, args.table)
    registry, grants = table_scan(spark, args.registry), table_scan(spark, args.grants)
    scoped = P.open_table(table, registry, grants, args.role, args.name)
    report = role_report(scoped, args.role)
    print(RECORD_LINE.format(report["row_count"].first().rentals))
    scoped.printSchema()
    print()
    show_report(report, args.rows, truncate=False)


if __name__ == "__main__":
    main()
