"""The rentals table as a view over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The columns used here, declared: reading a table then starts no schema-inference job.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Tasks among which one user's rows are dealt out.
SALTS = 8

# Each rentals column over the joined test tables.
COLUMNS = (
    "concat('R-', cast(event_id AS string)) AS rental_id",
    "cast(user_id AS string) AS station_id",
    "concat('Station ', cast(user_id AS string)) AS station_name",
    "ts AS rental_date",
    "timestampadd(MINUTE, cast(floor(value) AS int), ts) AS return_date",
    "cast(floor(value) AS int) AS usage_min",
    "cast(value * cast(get_json_object(props, '$.k') AS int) AS decimal(12,2)) AS distance_meter",
    "CASE WHEN user_id % 53 = 0 THEN 'N' WHEN user_id % 41 = 0 THEN NULL "
    "ELSE cast(1940 + (user_id * 7) % 71 AS string) END AS birth_year",
    "CASE WHEN user_id % 25 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'F' ELSE 'M' END AS gender",
    "CASE WHEN event_type = 'signup' THEN 'new' ELSE 'member' END AS user_type",
    "place AS district",
)


def rentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rentals: users play stations, nations play districts.

    Both dimensions are grouped by their join key, so Catalyst knows that the key is unique and
    drops the joins from any query that does not use ``district``. Where they stay, no side is
    hinted: Spark broadcasts a dimension while it is under the size threshold and beyond it
    shuffles both sides. A grouped side keeps adaptive execution from splitting a hot user, so the
    join key has a salt: a user's rows go to ``SALTS`` tasks, and the few columns of the dimension
    are copied as often, before they are grouped. The station-without-district rule sits in the
    join condition, which leaves ``district`` a plain column: a district predicate makes the joins
    inner ones.
    """
    events = read_table(spark, sf_dir, "events")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    homes = (
        read_table(spark, sf_dir, "customer")
        .withColumn("salt", salts)
        .groupBy("c_custkey", "salt")
        .agg({"c_nationkey": "min"})
        .toDF("c_custkey", "salt", "home")
    )
    places = (
        read_table(spark, sf_dir, "nation")
        .groupBy("n_nationkey")
        .agg({"n_name": "min"})
        .toDF("n_nationkey", "place")
    )
    salt = F.pmod(F.hash(events.event_id), F.lit(SALTS))
    has_home = (events.user_id == homes.c_custkey) & (salt == homes.salt) & (events.user_id % 50 != 49)
    return (
        events.join(homes, has_home, "left")
        .join(places, homes.home == places.n_nationkey, "left")
        .selectExpr(*COLUMNS)
    )
