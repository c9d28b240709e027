"""Interval, window and running-state queries over alarms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cascata.functions.scalars import device_state
from cascata.operators import alarms as A
from cascata.operators import intervals as I
from cascata.queries.registry import alarms, query

MIN = 60_000_000
_SPANS = "iv AS (SELECT ne, kind, ts AS s, CASE WHEN kind = 'offline' AND port >= 95 THEN NULL ELSE ts + CAST(floor(value * 3600000000) AS BIGINT) END AS e FROM alarms)"


def spans(spark, sf_dir):
    end = F.when(~((F.col("kind") == "offline") & (F.col("port") >= 95)), F.col("ts") + F.floor(F.col("value") * 3_600_000_000).cast("long"))
    return alarms(spark, sf_dir).select("ne", "kind", F.col("ts").alias("start_ts"), end.alias("end_ts"))


@query(
    "interval_union",
    "WITH {alarms}, " + _SPANS + """, f AS (SELECT ne, kind, s, coalesce(e, 9223372036854775807) AS e FROM iv),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY ne, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY ne, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT ne, kind, min(s) AS start_ts, CASE WHEN max(e) < 9223372036854775807 THEN max(e) END AS end_ts, count(*) AS n FROM i GROUP BY ne, kind, island""",
)
def interval_union(spark, sf_dir):
    return I.union_intervals(spans(spark, sf_dir), ["ne", "kind"])


_MERGED = """p AS (SELECT DISTINCT ne, ts // 1000000 AS t FROM alarms WHERE kind = 'offline'),
pm AS (SELECT *, CASE WHEN t - 1800 > lag(t) OVER w + 1800 IS NOT FALSE THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY ne ORDER BY t)),
pi AS (SELECT *, sum(new) OVER (PARTITION BY ne ORDER BY t) AS island FROM pm),
win AS (SELECT ne, min(t) - 1800 AS start_ts, max(t) + 1800 AS end_ts FROM pi GROUP BY ne, island)"""


def offline_windows(spark, sf_dir):
    a = alarms(spark, sf_dir)
    return I.merged_windows(a.where("kind = 'offline'").select("ne", F.floor(F.col("ts") / 1_000_000).alias("t")), ["ne"], "t", 1800)


@query("merged_windows", "WITH {alarms}, " + _MERGED + " SELECT * FROM win")
def merged_windows(spark, sf_dir):
    return offline_windows(spark, sf_dir)


@query("alarms_in_windows", "WITH {alarms}, " + _MERGED + " SELECT eid FROM alarms a WHERE EXISTS (SELECT 1 FROM win WHERE win.ne = a.ne AND a.ts // 1000000 BETWEEN start_ts AND end_ts)")
def alarms_in_windows(spark, sf_dir):
    points = alarms(spark, sf_dir).withColumn("t", F.floor(F.col("ts") / 1_000_000))
    return I.in_windows(points, offline_windows(spark, sf_dir), ["ne"], "t", 3600).select("eid")


@query("as_of_state", "WITH {alarms} SELECT q.eid, (SELECT kind FROM alarms c WHERE c.ne = q.ne AND c.kind <> 'purchase' AND c.kind <> 'clear' AND c.ts <= q.ts - 3600000000 ORDER BY c.ts DESC, c.kind DESC LIMIT 1) AS kind FROM alarms q WHERE q.kind = 'clear'")
def as_of_state(spark, sf_dir):
    a = alarms(spark, sf_dir)
    asked = a.where("kind = 'clear'").select("eid", "ne", (F.col("ts") - 3_600_000_000).alias("ts"))
    found = I.state_as_of(a.where("kind <> 'clear'"), asked.select("ne", "ts").distinct(), "ne", "ts", "kind")
    return asked.join(found, ["ne", "ts"], "left").select("eid", "kind")


@query("sessions_over_gap", "WITH {alarms}, m AS (SELECT *, CASE WHEN (ts - lag(ts) OVER w > 21600000000) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM alarms WINDOW w AS (PARTITION BY ne ORDER BY ts, eid)), s AS (SELECT *, sum(new) OVER (PARTITION BY ne ORDER BY ts, eid) AS session FROM m) SELECT ne, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ne, session")
def sessions_over_gap(spark, sf_dir):
    s = I.sessions(alarms(spark, sf_dir), ["ne"], "ts", 21_600_000_000, strict=True)
    return s.groupBy("ne", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("bulk_windows", "WITH {alarms}, w AS (SELECT *, count(*) OVER (PARTITION BY ts // 3600000000) AS n FROM alarms WHERE kind = 'clear') SELECT site, count(*) AS clears, count(*) FILTER (WHERE n >= 4) AS bulk FROM w GROUP BY site")
def bulk_windows(spark, sf_dir):
    marked = I.bulk_windows(alarms(spark, sf_dir).where("kind = 'clear'"), "ts", 3_600_000_000, 4)
    return marked.groupBy("site").agg(F.count("*").alias("clears"), F.count_if("bulk").alias("bulk"))


@query("sliding_windows", "WITH {alarms}, w AS (SELECT site, kind, unnest(generate_series((ts - 420000000) // 60000000 * 60000000 + 60000000, ts // 60000000 * 60000000, 60000000)) AS window_start FROM alarms) SELECT window_start, site, count(*) AS n, count(DISTINCT kind) AS kinds FROM w GROUP BY window_start, site")
def sliding_windows(spark, sf_dir):
    w = I.sliding_windows(alarms(spark, sf_dir).select("site", "kind", "ts"), "ts", 7 * MIN, MIN)
    return w.groupBy("window_start", "site").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))


_STATES = """ev AS (SELECT eid, ne, ts, CASE port % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'power' ELSE 'offline' END AS k, kind = 'clear' OR kind = 'other' AS c FROM alarms),
d AS (SELECT eid, ne, ts, unnest(['link', 'power', 'offline']) AS g, k, c FROM ev),
s AS (SELECT eid, ne, ts, g, sum(CASE WHEN k = g THEN CASE WHEN c THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY ne, g ORDER BY ts, eid) AS run FROM d),
b AS (SELECT eid, ne, g, coalesce(lag(run) OVER w, 0) - least(0, coalesce(min(run) OVER (PARTITION BY ne, g ORDER BY ts, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS up FROM s WINDOW w AS (PARTITION BY ne, g ORDER BY ts, eid))"""


@query("device_state", "WITH {alarms}, " + _STATES + " SELECT eid, CAST(max(CASE WHEN g = 'link' THEN up END) AS BIGINT) AS link_up, CAST(max(CASE WHEN g = 'power' THEN up END) AS BIGINT) AS power_up, CAST(max(CASE WHEN g = 'offline' THEN up END) AS BIGINT) AS offline_up, CAST(max(CASE WHEN g = 'link' AND up > 0 THEN 1 ELSE 0 END) + 2 * max(CASE WHEN g = 'power' AND up > 0 THEN 1 ELSE 0 END) + 4 * max(CASE WHEN g = 'offline' AND up > 0 THEN 1 ELSE 0 END) AS INT) AS state FROM b GROUP BY eid")
def device_states(spark, sf_dir):
    m = F.col("port") % 3
    ev = alarms(spark, sf_dir).select("eid", "ne", "ts", F.when(m == 0, "link").when(m == 1, "power").otherwise("offline").alias("kind"), F.col("kind").isin("clear", "other").alias("is_clear"))
    out = I.running_states(ev, "ne", ["link", "power", "offline"], "ts", "eid")
    return out.select("eid", "link_up", "power_up", "offline_up", device_state(F.col("link_up") > 0, F.col("power_up") > 0, F.col("offline_up") > 0).alias("state"))


@query("top_edges_per_site", "WITH {alarms} SELECT site, ne, count(*) AS n, count(DISTINCT kind) AS kinds FROM alarms GROUP BY site, ne QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, ne) <= 3")
def top_edges_per_site(spark, sf_dir):
    g = alarms(spark, sf_dir).groupBy("site", "ne").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "ne"))).where("_r <= 3").drop("_r")


@query("first_alarm_per_device", "WITH {alarms} SELECT ne, arg_min(eid, (ts, eid)) AS eid, min(ts) AS ts FROM alarms GROUP BY ne")
def first_alarm_per_device(spark, sf_dir):
    return A.first_by(alarms(spark, sf_dir).select("ne", "eid", "ts"), ["ne"], F.struct("ts", "eid"))


@query("alarm_periods", "WITH {alarms}, m AS (SELECT *, CASE WHEN (ts - lag(ts) OVER w >= 10800000000) IS NOT FALSE OR (lag(kind) OVER w) = 'clear' THEN 1 ELSE 0 END AS new FROM alarms WINDOW w AS (PARTITION BY ne ORDER BY ts, eid)), s AS (SELECT *, sum(new) OVER (PARTITION BY ne ORDER BY ts, eid) AS island FROM m), p AS (SELECT ne, island, min(ts) FILTER (WHERE kind <> 'clear') AS start_ts, max(ts) FILTER (WHERE kind <> 'clear') AS latest_ts, count(*) FILTER (WHERE kind <> 'clear') AS raises, coalesce(bool_or(kind = 'clear'), false) AS cleared FROM s GROUP BY ne, island) SELECT ne, start_ts, latest_ts, raises, cleared FROM p WHERE raises > 0")
def alarm_periods(spark, sf_dir):
    from cascata.streaming.periods import batch_periods

    return batch_periods(alarms(spark, sf_dir).select("ne", "eid", "ts", (F.col("kind") == "clear").alias("is_clear")), ["ne"], 10_800_000_000).select("ne", "start_ts", "latest_ts", "raises", "cleared")
