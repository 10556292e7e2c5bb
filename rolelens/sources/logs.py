"""Record and column counts out of job logs, read by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The log texts that carry the counts.
RECORD_PATTERN = r"✅.*레코드 수:\s*([0-9,]+)건"
RECORD_LINE = "✅ 필터링 후 레코드 수: {:,}건"
SCHEMA_START = "root"
SCHEMA_COLUMN = "|--"


def log_metrics(spark: SparkSession, path: str, roles: DataFrame | None = None) -> DataFrame:
    """Per log file: records and columns, each 0 when the log does not say.

    Records is the first count in the file; columns are the marks between the first line with
    ``root`` and the next empty line, 0 if either is missing. Folders named ``role=<role>`` add a
    ``role`` column. With ``roles`` (column role) there is a row for each of them, also for those
    without a log, and ``log_available`` tells which have one. An empty file is no log.

    Files are read by line, so their size does not matter: per file only positions and counts are
    kept, combined map-side.
    """
    files = spark.read.format("binaryFile").load(path)  # names alone; the content is not read
    keys = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    files = files.select(F.col("_metadata.file_path").alias("path"), *keys)

    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("path"),
        # a part of a file is read in order by one task
        F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        "value",
    )
    digits = F.regexp_replace(F.regexp_extract("value", RECORD_PATTERN, 1), ",", "")
    said = F.regexp_like("value", F.lit(RECORD_PATTERN))
    is_start = F.contains("value", F.lit(SCHEMA_START))
    marks = (F.length("value") - F.length(F.replace("value", F.lit(SCHEMA_COLUMN), F.lit("")))) / len(SCHEMA_COLUMN)
    counts = lines.where(said).groupBy("path").agg(F.min_by(digits.try_cast("long"), "at").alias("records"))
    starts = lines.where(is_start).groupBy("path").agg(F.min("at").alias("start"))
    after = lines.where((F.col("value") == "") | (marks > 0)).join(starts, "path").where("at >= start")
    ends = after.where("value = ''").groupBy("path").agg(F.min("at").alias("end"))
    blocks = after.join(ends, "path").where("at < end").groupBy("path").agg(F.sum(marks).cast("long").alias("columns"))

    zero = F.lit(0).cast("long")
    out = files.join(counts, "path", "left").join(blocks, "path", "left").select(
        "path", *keys, F.coalesce("records", zero).alias("records"), F.coalesce("columns", zero).alias("columns")
    )
    if roles is None:
        return out
    return roles.select("role").distinct().join(out, "role", "left").select(
        "role", "path", F.col("path").isNotNull().alias("log_available"),
        F.coalesce("records", zero).alias("records"), F.coalesce("columns", zero).alias("columns"),
    )
