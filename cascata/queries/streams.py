"""Batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cascata.queries.registry import alarms, query
from cascata.streaming import hygiene as H


@query("stream_hygiene")
def stream_hygiene(spark, sf_dir):
    a = alarms(spark, sf_dir).select(F.col("ne").alias("key"), F.col("eid").alias("event_id"), (F.col("ts") / 1e6).alias("ts"), (F.col("kind") == "clear").alias("is_clear"), F.col("eid").alias("arrival"))
    return H.sanitize(a, ["key"], H.Policy(duplicate_s=3600, flap_s=7200)).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "pending_maturity",
    """WITH RECURSIVE {alarms}, t AS (SELECT site, ts, row_number() OVER (PARTITION BY site ORDER BY ts) AS i FROM alarms WHERE kind = 'offline'),
r(site, i, first_ts) AS (SELECT site, i, ts FROM t WHERE i = 1 UNION ALL SELECT t.site, t.i, CASE WHEN t.ts >= r.first_ts + 7200000000 THEN t.ts ELSE r.first_ts END FROM r JOIN t ON t.site = r.site AND t.i = r.i + 1)
SELECT site, first_ts, first_ts + 7200000000 AS ready_ts, max(t.ts) AS last_ts, count(*) AS n FROM r JOIN t USING (site, i) GROUP BY site, first_ts""",
)
def pending_maturity(spark, sf_dir):
    t = alarms(spark, sf_dir).where("kind = 'offline'").select("site", "ts")
    return H.pending_maturity(t, ["site"], 7_200_000_000)


@query("cleared_occurrences", "WITH {alarms}, c AS (SELECT ne, ts FROM alarms WHERE kind = 'clear') SELECT eid FROM alarms a WHERE kind = 'offline' AND NOT EXISTS (SELECT 1 FROM c WHERE c.ne = a.ne AND c.ts <= a.ts + 1800000000 AND c.ts >= a.ts)")
def cleared_occurrences(spark, sf_dir):
    """An occurrence here is an element's offline alarm; it is cleared by the element's next clear."""
    from pyspark.sql import Window

    a = alarms(spark, sf_dir)
    w = Window.partitionBy("ne").orderBy("ts", "eid").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("kind") == "clear", F.col("ts"))).over(w)
    marked = a.withColumn("clear_ts", nxt).where("kind = 'offline'").withColumn("eval_ts", F.col("ts") + 1_800_000_000)
    return H.without_cleared(marked.drop("clear_ts"), marked.where("clear_ts is not null"), ["eid"]).select("eid")


@query("ttl_eviction", "WITH {alarms} SELECT kind, count(*) AS n FROM alarms WHERE (SELECT max(ts) FROM alarms) - ts <= CASE WHEN kind = 'power' THEN 864000000000 ELSE 432000000000 END GROUP BY kind")
def ttl_eviction(spark, sf_dir):
    a = alarms(spark, sf_dir)
    now = a.agg(F.max("ts")).first()[0]
    return H.unexpired(a, now, 432_000_000_000, 864_000_000_000).groupBy("kind").agg(F.count("*").alias("n"))
