"""CSV to Parquet: scan, type, reject rows without keys, write, reconcile."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.functions import scalar as S
from rolelens.schema import RAW_SCHEMA, RENTAL_COLUMNS, RENTAL_SCHEMA, REQUIRED_KEYS, require
from rolelens.sources.versions import VersionedTable


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """The file's first eleven columns as text, by position, header skipped.

    Further columns are dropped and missing ones are NULL. Empty fields are NULL; quoted commas
    are data. Records do not span lines, so large files split across tasks.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Declared types; a value that does not parse becomes NULL."""
    require(raw, *RENTAL_COLUMNS)

    def typed(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            return S.as_timestamp(column).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return column
        return column.try_cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in RENTAL_SCHEMA])


def accepted(raw: DataFrame, keys: Sequence[str] = REQUIRED_KEYS) -> DataFrame:
    """Typed rows whose key texts are all present. A junk date stays, as NULL."""
    return normalise(raw.dropna(subset=list(keys)))


# --- tables ------------------------------------------------------------------------------------


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet path when the name holds a slash."""
    return spark.read.parquet(name) if "/" in name else spark.read.table(name)


def create_table(
    spark: SparkSession, name: str, path: str, schema: T.StructType = RENTAL_SCHEMA
) -> DataFrame:
    """An empty Parquet table (Snappy) with the declared schema at a location."""
    return spark.catalog.createTable(
        name, path=path, source="parquet", schema=schema, compression="snappy"
    )


def replace_table(
    spark: SparkSession, name: str, path: str, schema: T.StructType = RENTAL_SCHEMA, rows: DataFrame | None = None
) -> DataFrame:
    """Put a table with the declared schema in place of the one of that name, empty or with ``rows``.

    The new rows are written to a folder of their own under ``path`` first. A table that exists with this
    schema is then turned to the new folder in one change of the catalog, so readers see the former rows or the
    new ones; another one is dropped and created.
    """
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    rows = spark.createDataFrame([], schema) if rows is None else rows.select(*schema.names)
    rows.write.option("compression", "snappy").parquet(folder)
    if spark.catalog.tableExists(name) and _plain(spark.table(name).schema) == _plain(schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(name)
        return spark.table(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return create_table(spark, name, folder, schema)


def _plain(schema: T.StructType) -> list[tuple]:
    return [(f.name, f.dataType) for f in schema]


def load_insert(
    raw: DataFrame, table: str, cluster_by: Sequence[str] = ("district",)
) -> DataFrame:
    """Append the accepted rows to a table and return the table.

    Each task sorts its own rows by ``cluster_by`` (no shuffle), so Parquet row groups hold few
    districts and the row filter of a district role skips most of them.
    """
    rows = accepted(raw)
    if cluster_by:
        rows = rows.sortWithinPartitions(*cluster_by)
    rows.write.insertInto(table)
    raw.sparkSession.catalog.refreshTable(table)
    return raw.sparkSession.table(table)


def load(
    spark: SparkSession,
    src: str,
    dst: str,
    mode: str = "overwrite",
    cluster_by: Sequence[str] = ("district",),
) -> DataFrame:
    """CSV file to a Parquet folder; returns the stored table."""
    rows = accepted(csv_scan(spark, src))
    if cluster_by:
        rows = rows.sortWithinPartitions(*cluster_by)
    rows.write.mode(mode).option("compression", "snappy").parquet(dst)
    return spark.read.schema(RENTAL_SCHEMA).parquet(dst)


def load_staged(
    spark: SparkSession,
    src: str,
    dst: str,
    load_id: str,
    replace: bool = False,
    cluster_by: Sequence[str] = ("district",),
) -> VersionedTable:
    """CSV file to a versioned table, in one commit; returns the table.

    Rows are written aside first, so that readers see the former version until all are there, also while the
    table is replaced, and a failed load leaves nothing. The same ``load_id`` again changes nothing.
    """
    rows = accepted(csv_scan(spark, src))
    if cluster_by:
        rows = rows.sortWithinPartitions(*cluster_by)
    table = VersionedTable(spark, dst, RENTAL_SCHEMA)
    table.commit(rows, load_id, replace)
    return table


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, NULLs and their places included, as whole numbers that can be summed."""
    fields = [F.to_json(F.struct(F.col(c).cast("string").alias("v"))) for c in df.columns]
    hashed = (F.xxhash64(*fields), F.xxhash64(F.lit(1), *reversed(fields)))
    return [h.cast("decimal(38,0)") for h in hashed]


def content_checksum(df: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """range, rows, low, high, sum_1, sum_2: what rows a table holds, whatever their order or files.

    Rows are dealt into ranges by a hash of their key; ``low`` and ``high`` are the range's first and last key. Sums of
    hashes add up map-side; equal multisets of rows have equal sums, and different ones do with a chance of
    about 2^-128 for each range.
    """
    require(df, key)
    one, two = row_hashes(df)
    text = F.col(key).cast("string")
    by = F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(ranges)).cast("int").alias("range")
    return df.groupBy(by).agg(
        F.count("*").alias("rows"), F.min(text).alias("low"), F.max(text).alias("high"),
        F.sum(one).alias("sum_1"), F.sum(two).alias("sum_2"),
    )


def content_reconcile(source: DataFrame, loaded: DataFrame, key: str = "rental_id", ranges: int = 64) -> DataFrame:
    """One row per key range: rows on both sides, first and last key, and whether the contents are equal.

    ``source`` are the raw rows; those without keys are left out and values typed as a load does.
    """
    left = content_checksum(accepted(source), key, ranges).select(F.lit(0).alias("side"), "*")
    right = content_checksum(loaded.select(*RENTAL_COLUMNS), key, ranges).select(F.lit(1).alias("side"), "*")
    both = left.unionByName(right)

    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    same = [of(0, c).eqNullSafe(of(1, c)) for c in ("rows", "sum_1", "sum_2")]
    return both.groupBy("range").agg(
        F.coalesce(of(0, "rows"), F.lit(0)).alias("source_rows"),
        F.coalesce(of(1, "rows"), F.lit(0)).alias("loaded_rows"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        reduce(Column.__and__, same).alias("ok"),
    )


def load_reconcile(
    source: DataFrame, loaded: DataFrame, keys: Sequence[str] = REQUIRED_KEYS
) -> DataFrame:
    """One row: source, loaded and rejected rows, rejections per key, and whether they add up."""
    require(source, *keys)
    missing = {k: F.col(k).isNull() for k in keys}
    any_missing = reduce(lambda a, b: a | b, missing.values())
    left = source.agg(
        F.count("*").alias("source_rows"),
        F.count_if(any_missing).alias("rejected_rows"),
        *[F.count_if(m).alias(f"missing_{k}") for k, m in missing.items()],
    )
    right = loaded.agg(F.count("*").alias("loaded_rows"))
    sides = left.unionByName(right, allowMissingColumns=True)
    names = ["source_rows", "loaded_rows", "rejected_rows", *[f"missing_{k}" for k in keys]]
    totals = sides.agg(*[F.sum(n).alias(n) for n in names])
    return totals.withColumn(
        "ok", F.col("source_rows") - F.col("rejected_rows") == F.col("loaded_rows")
    )


def schema_report(df: DataFrame) -> DataFrame:
    """Visible columns with position, type and nullability."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean"
    )


def preview(df: DataFrame, n: int = 10, order: str = "rental_id") -> DataFrame:
    """First rows by a key, so that the result repeats."""
    require(df, order)
    return df.orderBy(order).limit(n)
