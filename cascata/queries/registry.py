"""Registration of driver-facing queries with the SQL that states the same result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: How the driver's tables stand for alarms: who raised it (network element), at which site, of what class.
KINDS = {"error": "offline", "view": "link", "click": "power", "purchase": "clear", "signup": "other"}

ALARMS_SQL = """alarms AS (
  SELECT event_id AS eid, user_id AS ne, c_nationkey AS site, n_regionkey AS region, epoch_us(ts) AS ts, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS port,
         CASE event_type WHEN 'error' THEN 'offline' WHEN 'view' THEN 'link' WHEN 'click' THEN 'power' WHEN 'purchase' THEN 'clear' ELSE 'other' END AS kind
  FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey)"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may begin with ``WITH {alarms}``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{alarms}", ALARMS_SQL)
        return f

    return add


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, ne, site, region, ts (microseconds), value, port, kind."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    dims = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.lit(None).cast("string")
    for name, value in KINDS.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    joined = events.join(dims, F.col("user_id") == F.col("c_custkey"))
    return joined.select(
        F.col("event_id").alias("eid"), F.col("user_id").alias("ne"), F.col("c_nationkey").alias("site"), F.col("n_regionkey").alias("region"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value", F.get_json_object("props", "$.k").cast("long").alias("port"), kind.alias("kind"),
    )
