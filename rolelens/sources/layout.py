"""Tables laid out for skipping: one global order of rows, and Bloom filters on columns that are looked up.

A load sorts each task's rows by itself, so every file may hold every district. Here rows are dealt into files
by sampled bounds of the order, so a value lies in few files and the row groups and pages of the others
are skipped by their own smallest and largest values. A column that the order scatters, such as the
station, gets a Bloom filter in each row group instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rolelens.schema import require

#: Rows of a file; with the rentals' columns some 100 MB.
ROWS_PER_FILE = 4_000_000


def write_clustered(
    rows: DataFrame,
    path: str,
    by: Sequence[str] = ("district", "rental_date"),
    lookup: Sequence[str] = ("station_id",),
    spread: str = "rental_id",
    files: int | None = None,
    distinct: int = 100_000,
) -> DataFrame:
    """Write ``rows`` to a Parquet folder in one order of ``by`` and return the stored table.

    ``spread`` ends the order, so that the rows of one frequent value are cut into several files. ``files``
    follows from the number of rows unless it is given. ``lookup`` columns get Bloom filters made for
    ``distinct`` values a row group; more values make them let more row groups pass, never fewer.
    The rows are read three times (number, bounds, shuffle), so store them first if they are costly.
    NULLs come first in the order. An empty table is one empty file.
    """
    order = [*by, *([spread] if spread not in by else [])]
    require(rows, *order, *lookup)
    if files is None:
        files = max(1, -(-rows.count() // ROWS_PER_FILE))
    writer = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("compression", "snappy")
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
