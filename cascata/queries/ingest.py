"""Ingest, identity, projection and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascata.functions import scalars as X
from cascata.operators import alarms as A
from cascata.queries.registry import alarms, query
from cascata.session import table

TITLES = ["error", "view", "click"]
_RAW_SQL = """raw AS (
  SELECT event_id AS eid, event_type AS alarm_title, CAST(user_id AS VARCHAR) AS alarm_source,
         CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'none' ELSE CAST(c_nationkey AS VARCHAR) END AS site_id, c_nationkey,
         date_trunc('second', ts) AS first_at, CASE WHEN value >= 10 THEN date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT)) END AS clear_at
  FROM events JOIN customer ON c_custkey = user_id)"""


def raw_alarms(spark, sf_dir: str) -> DataFrame:
    """Events in the shape of raw alarm records: texts, blank or unknown sites, optional clear times."""
    e = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("user_id"))
    first = F.date_trunc("second", F.col("ts").cast("timestamp"))
    site = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    clear = F.when(F.col("value") >= 10, F.timestamp_seconds(F.unix_seconds(first) + F.floor("value")))
    return e.select(
        F.col("event_id").alias("eid"), F.col("event_type").alias("alarm_title"), F.col("user_id").cast("string").alias("alarm_source"), site.alias("site_id"),
        F.date_format(first, "yyyy-MM-dd HH:mm:ss").alias("first_time"), F.date_format(clear, "yyyy/MM/dd HH:mm:ss").alias("clear_time"),
    )


def _ne_site(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ne_id"), F.col("c_nationkey").cast("string").alias("site_id"))


def _valid_sites(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("site_id"))


_NORMAL_SQL = (
    "WITH "
    + _RAW_SQL
    + """, ok AS (
  SELECT eid, alarm_source, CAST(c_nationkey AS VARCHAR) AS site_id, alarm_title, first_at, clear_at FROM raw
  WHERE alarm_title IN ('error', 'view', 'click') AND c_nationkey < 20 AND first_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'),
ev AS (
  SELECT eid, alarm_source, site_id, alarm_title, epoch_us(first_at) AS ts, false AS is_clear FROM ok
  UNION ALL SELECT eid, alarm_source, site_id, alarm_title, epoch_us(first_at + greatest(to_seconds(15), clear_at - first_at)), true FROM ok WHERE clear_at IS NOT NULL)
"""
)


def _normalized(spark, sf_dir):
    us = lambda day: int(day) * 86_400_000_000 + 1_704_067_200_000_000  # noqa: E731  days from 2024-01-01
    return A.normalize(raw_alarms(spark, sf_dir), TITLES, _ne_site(spark, sf_dir), _valid_sites(spark, sf_dir), us(2), us(24), 15.0)


@query("alarm_normalize", _NORMAL_SQL + "SELECT * FROM ev")
def alarm_normalize(spark, sf_dir):
    return _normalized(spark, sf_dir)


@query("event_class_counts", _NORMAL_SQL + "SELECT count(*) FILTER (WHERE NOT is_clear) AS raises, count(*) FILTER (WHERE is_clear) AS clears FROM ev")
def event_class_counts(spark, sf_dir):
    return A.event_classes(_normalized(spark, sf_dir))


@query("trim_trailing_clears", _NORMAL_SQL + "SELECT * FROM ev WHERE (ts, eid, is_clear) <= (SELECT (ts, eid, is_clear) FROM ev WHERE NOT is_clear ORDER BY ts DESC, eid DESC LIMIT 1)")
def trim_trailing_clears(spark, sf_dir):
    return A.trim_trailing_clears(_normalized(spark, sf_dir))


@query("time_sorted_rank", _NORMAL_SQL + "SELECT eid, is_clear, ts FROM ev ORDER BY ts, eid, is_clear LIMIT 100")
def time_sorted_rank(spark, sf_dir):
    return A.time_sorted(_normalized(spark, sf_dir), "eid", "is_clear").limit(100).select("eid", "is_clear", "ts")


@query("site_resolution", "WITH " + _RAW_SQL + " SELECT eid, CASE WHEN site_id <> '' THEN site_id ELSE CAST(c_nationkey AS VARCHAR) END AS site_id FROM raw")
def site_resolution(spark, sf_dir):
    return A.resolve_site(raw_alarms(spark, sf_dir), _ne_site(spark, sf_dir)).select("eid", "site_id")


@query(
    "latest_wins",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1""",
)
def latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    return A.latest_wins(rows, ["l_partkey", "l_suppkey"], F.col("shipped"), F.col("l_orderkey"), F.col("l_linenumber"))


@query("duplicate_audit", "SELECT l_partkey * 100000 + l_suppkey AS key, count(*) AS n, count(DISTINCT (l_quantity, l_returnflag)) AS variants FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("key"), "l_quantity", "l_returnflag")
    return A.duplicate_audit(rows, "key", "l_quantity", "l_returnflag")


@query(
    "merge_occurrences",
    """WITH parts AS (SELECT o_custkey, o_orderkey, unnest(['role-' || o_orderstatus, substr(o_orderpriority, 1, 1)]) AS p, unnest([1, 2]) AS i FROM orders),
firsts AS (SELECT o_custkey, p, min((o_orderkey, i)) AS f FROM parts GROUP BY o_custkey, p)
SELECT o_custkey, string_agg(p, ',' ORDER BY f) AS roles, (SELECT count(*) FROM orders o WHERE o.o_custkey = firsts.o_custkey) AS records FROM firsts GROUP BY o_custkey""",
)
def merge_occurrences(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("_order"), F.concat(F.lit("role-"), "o_orderstatus", F.lit(";"), F.substring("o_orderpriority", 1, 1)).alias("roles"))
    return A.merge_occurrences(rows, ["o_custkey"], ["roles"]).withColumn("roles", F.array_join("roles", ","))


@query("field_coverage", "SELECT field, count(v) AS present, count(*) FILTER (WHERE trim(v) <> '') AS filled FROM (SELECT unnest(['event_id', 'props', 'clear']) AS field, unnest([CAST(event_id AS VARCHAR), props, CASE WHEN value >= 10 THEN '' WHEN value < 5 THEN 'x' END]) AS v FROM events) GROUP BY field")
def field_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("value") >= 10, "").when(F.col("value") < 5, "x").alias("clear"))
    return A.field_coverage(rows)


@query("alarm_time_range", "WITH {alarms} SELECT kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM alarms GROUP BY kind")
def alarm_time_range(spark, sf_dir):
    return alarms(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("split_fraction", "SELECT event_id, ('0x' || substr(md5('42::' || CAST(event_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS fraction FROM events")
def split_fraction(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.hash_fraction(F.col("event_id").cast("string"), "42").alias("fraction"))


@query(
    "train_val_split",
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN k > n - CAST(floor(n * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS part FROM r",
)
def train_val_split(spark, sf_dir):
    return A.split_by_time(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 0.2).select("event_id", "part")


@query(
    "region_filter",
    "WITH {alarms} SELECT CASE WHEN region IN (1, 3) THEN 'kept' ELSE 'dropped' END AS fate, count(*) AS n FROM alarms GROUP BY 1",
)
def region_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "region").where(F.col("r_regionkey").isin(1, 3)).select(F.col("r_regionkey").alias("region"), F.lit(True).alias("in_region"))
    rows = alarms(spark, sf_dir).join(F.broadcast(wanted), "region", "left")
    return rows.groupBy(F.when(F.col("in_region"), "kept").otherwise("dropped").alias("fate")).agg(F.count("*").alias("n"))


@query(
    "keyword_join",
    """WITH words AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS w FROM benchmark),
keys AS (SELECT w, min(item_id) AS item_id FROM words GROUP BY w),
hits AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM documents)
SELECT doc_id, count(*) AS n_keywords, min(item_id) AS first_item FROM hits JOIN keys USING (w) GROUP BY doc_id""",
)
def keyword_join(spark, sf_dir):
    """Keyword hits as a token equi join: words of the texts against words of the dictionary."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{9,}"), 0))
    keys = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words("text")).alias("w")).groupBy("w").agg(F.min("item_id").alias("item_id"))
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(words("text")).alias("w"))
    return hits.join(keys, "w").groupBy("doc_id").agg(F.count("*").alias("n_keywords"), F.min("item_id").alias("first_item"))


@query("type_labels", "WITH {alarms} SELECT kind || ' | ' || site || ' | ' || CASE WHEN port % 10 = 0 THEN '<empty>' ELSE CAST(port AS VARCHAR) END AS label, count(*) AS n FROM alarms GROUP BY 1")
def type_labels(spark, sf_dir):
    port = F.when(F.col("port") % 10 == 0, "").otherwise(F.col("port").cast("string"))
    return alarms(spark, sf_dir).groupBy(X.type_label(F.col("kind"), F.col("site"), port).alias("label")).agg(F.count("*").alias("n"))


@query(
    "geo_pairs",
    """WITH g AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1600) / 10.0::DOUBLE - 80 AS lat, (s_suppkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lon FROM supplier)
SELECT a.id AS a, b.id AS b, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km
FROM g a JOIN g b ON a.id < b.id
WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 500""",
)
def geo_pairs(spark, sf_dir):
    from cascata.operators.graph import radius_pairs

    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 37 % 1600) / F.lit(10.0) - 80).alias("lat"), ((k * 91 % 3600) / F.lit(10.0) - 180).alias("lon"))
    return radius_pairs(points, "id", 500.0).select("a", "b", F.round("km", 3).alias("km"))
