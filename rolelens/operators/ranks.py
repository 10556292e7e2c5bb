"""Finding values by rank without sorting the data or gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locate(
    hist: DataFrame, keys: Sequence[str], order: str, count: str, rank: str, keep: Sequence[str] = ()
) -> DataFrame:
    """The histogram row that holds each requested rank, per group.

    ``hist`` has one row per (keys, order) with its ``count``; ``rank`` is a column of
    (slot, rank) pairs, an array that may use ``_total``. Returns keys, order, ``keep``, ``slot``
    and ``within`` (the rank inside the located row). The window runs over histogram rows only.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("_upto", F.sum(count).over(upto))
        .withColumn("_total", F.sum(count).over(group))
        .withColumn("_want", F.explode(F.expr(rank)))
        .where(
            (F.col("_want.rank") <= F.col("_upto"))
            & (F.col("_want.rank") > F.col("_upto") - F.col(count))
        )
        .select(
            *keys,
            order,
            *keep,
            F.col("_want.slot").alias("slot"),
            (F.col("_want.rank") - F.col("_upto") + F.col(count)).alias("within"),
        )
    )
