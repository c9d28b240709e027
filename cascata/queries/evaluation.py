"""Recall, comparison and health queries. Orders are tickets, their customers' nations the sites; alarms form groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cascata.operators import metrics as M
from cascata.queries.graphs import MESH_SQL, TREE_SQL, mesh, tree
from cascata.queries.registry import alarms, query
from cascata.session import table

# Native group: the alarms of a kind within one region and six hours. Ticket: the offline alarms of an element on a day.
GROUPS_SQL = "grp AS (SELECT eid, ne, site, kind, ts, kind || '-' || region || '-' || CAST(ts // 21600000000 AS VARCHAR) AS group_id FROM alarms WHERE kind IN ('offline', 'link', 'power'))"
TICKETS_SQL = "tick AS (SELECT DISTINCT CAST(ne AS VARCHAR) || '/' || CAST(ts // 86400000000 AS VARCHAR) AS ticket, eid, site, ts FROM alarms WHERE kind IN ('offline', 'link'))"


def groups(spark, sf_dir):
    a = alarms(spark, sf_dir).where(F.col("kind").isin("offline", "link", "power"))
    return a.withColumn("group_id", F.concat_ws("-", "kind", "region", F.floor(F.col("ts") / 21_600_000_000))).select("eid", "ne", "site", "kind", "ts", "group_id")


def tickets(spark, sf_dir):
    a = alarms(spark, sf_dir).where(F.col("kind").isin("offline", "link"))
    return a.select(F.concat_ws("/", "ne", F.floor(F.col("ts") / 86_400_000_000)).alias("ticket"), "eid", "site", "ts")


@query(
    "ticket_site_metrics",
    "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + """, target AS (SELECT DISTINCT ticket, site FROM tick), pred AS (SELECT DISTINCT ticket, g2.site FROM tick JOIN grp g1 USING (eid) JOIN grp g2 ON g1.group_id = g2.group_id),
n AS (SELECT coalesce(t.ticket, p.ticket) AS ticket, count(t.site) AS n_target, count(p.site) AS n_predicted, count(*) FILTER (WHERE t.site IS NOT NULL AND p.site IS NOT NULL) AS n_hit FROM target t FULL JOIN pred p ON t.ticket = p.ticket AND t.site = p.site GROUP BY 1)
SELECT ticket, n_target, n_predicted, n_hit, round(n_hit / n_target::DOUBLE, 9) AS recall, round(n_hit / n_predicted::DOUBLE, 9) AS precision FROM n""",
)
def ticket_site_metrics(spark, sf_dir):
    g, t = groups(spark, sf_dir), tickets(spark, sf_dir)
    hit = t.join(g.select("eid", "group_id"), "eid").select("ticket", "group_id").distinct()
    predicted = hit.join(g.select("group_id", "site").distinct(), "group_id").select("ticket", "site")
    out = M.site_metrics(t.select("ticket", "site"), predicted, "ticket", "site")
    return out.select("ticket", "n_target", "n_predicted", "n_hit", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query(
    "ticket_recall_macro",
    "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + """, target AS (SELECT DISTINCT ticket, site FROM tick), pred AS (SELECT DISTINCT ticket, g2.site FROM tick JOIN grp g1 USING (eid) JOIN grp g2 ON g1.group_id = g2.group_id AND g2.kind = 'offline'),
n AS (SELECT t.ticket, count(*) AS n_target, count(p.site) AS n_hit FROM target t LEFT JOIN pred p ON t.ticket = p.ticket AND t.site = p.site GROUP BY 1)
SELECT count(*) AS tickets, round(avg(n_hit / n_target::DOUBLE), 9) AS macro_recall, count(*) FILTER (WHERE n_hit = n_target) AS full_tickets FROM n""",
)
def ticket_recall_macro(spark, sf_dir):
    g, t = groups(spark, sf_dir), tickets(spark, sf_dir)
    hit = t.join(g.select("eid", "group_id"), "eid").select("ticket", "group_id").distinct()
    predicted = hit.join(g.where("kind = 'offline'").select("group_id", "site").distinct(), "group_id").select("ticket", "site")
    out = M.site_metrics(t.select("ticket", "site"), predicted, "ticket", "site").where("n_target > 0")
    return out.agg(F.count("*").alias("tickets"), F.round(F.avg("recall"), 9).alias("macro_recall"), F.count_if(F.col("n_hit") == F.col("n_target")).alias("full_tickets"))


@query(
    "best_group",
    "WITH {alarms}, " + GROUPS_SQL + ", target AS (SELECT DISTINCT region AS ticket, site FROM alarms), g AS (SELECT group_id, site, bool_or(kind = 'offline') AS has_alarm FROM grp GROUP BY group_id, site) SELECT ticket, group_id, count(*) AS covered, count(*) FILTER (WHERE has_alarm) AS alarmed FROM target JOIN g USING (site) GROUP BY ticket, group_id QUALIFY row_number() OVER (PARTITION BY ticket ORDER BY count(*) DESC, count(*) FILTER (WHERE has_alarm) DESC, group_id) = 1",
)
def best_group(spark, sf_dir):
    g = groups(spark, sf_dir).select("group_id", "site", (F.col("kind") == "offline").alias("has_alarm"))
    return M.best_group(g, alarms(spark, sf_dir).select(F.col("region").alias("ticket"), "site"))


@query(
    "loose_expansion",
    "WITH RECURSIVE {alarms}, c AS (SELECT DISTINCT CAST(site AS VARCHAR) AS ticket, CAST(ne AS VARCHAR) || '@' || CAST(ts // 86400000000 AS VARCHAR) AS group_id, ts // 1000000 AS ts, kind FROM alarms), base AS (SELECT DISTINCT ticket, group_id FROM c WHERE kind = 'offline' AND ts % 7 = 0), near AS (SELECT DISTINCT a.ticket, a.group_id AS x, b.group_id AS y FROM c a JOIN c b ON a.ticket = b.ticket AND abs(a.ts - b.ts) <= 600), r(ticket, group_id) AS (SELECT * FROM base UNION SELECT r.ticket, near.y FROM r JOIN near ON near.ticket = r.ticket AND near.x = r.group_id) SELECT ticket, group_id FROM r",
)
def loose_expansion(spark, sf_dir):
    a = alarms(spark, sf_dir)
    c = a.select(F.col("site").cast("string").alias("ticket"), F.concat_ws("@", "ne", F.floor(F.col("ts") / 86_400_000_000)).alias("group_id"), F.floor(F.col("ts") / 1_000_000).alias("ts"), "kind")
    base = c.where("kind = 'offline' and ts % 7 = 0").select("ticket", "group_id")
    return M.expand_by_time(base, c.select("ticket", "group_id", "ts"), 600)


@query("group_percentiles", "WITH {alarms}, " + GROUPS_SQL + ", n AS (SELECT group_id, split_part(group_id, '-', 1) AS kind, count(*) AS n FROM grp GROUP BY group_id), s AS (SELECT kind, n, row_number() OVER (PARTITION BY kind ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY kind) AS t FROM n) SELECT kind, p, n AS value FROM s, (VALUES (50), (90), (99)) AS v(p) WHERE i = floor(p * (t - 1) / 100)")
def group_percentiles(spark, sf_dir):
    n = groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n")).withColumn("kind", F.substring_index("group_id", "-", 1))
    return M.floor_percentiles(n, "n", [50, 90, 99], ["kind"])


@query("duration_histogram", "WITH {alarms}, " + GROUPS_SQL + ", d AS (SELECT (max(ts) - min(ts)) / 1000000.0::DOUBLE AS d FROM grp GROUP BY group_id) SELECT CASE WHEN d <= 60 THEN '<=60' WHEN d <= 3600 THEN '<=3600' WHEN d <= 14400 THEN '<=14400' ELSE '>14400' END AS bucket, count(*) AS n FROM d GROUP BY 1")
def duration_histogram(spark, sf_dir):
    d = groups(spark, sf_dir).groupBy("group_id").agg(((F.max("ts") - F.min("ts")) / 1e6).alias("d"))
    return M.histogram(d, F.col("d"), [60, 3600, 14400])


@query("mann_whitney_auc", "WITH v AS (SELECT value AS v, event_type = 'error' AS w FROM events), r AS (SELECT v, w, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS mid FROM v), s AS (SELECT sum(mid) FILTER (WHERE w) AS rs, count(*) FILTER (WHERE w) AS n, count(*) FILTER (WHERE NOT w) AS m FROM r) SELECT round(1 - (rs - n * (n + 1) / 2.0::DOUBLE) / (n * m::DOUBLE), 9) AS auc, n AS n_within, m AS n_null FROM s")
def mann_whitney_auc(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("value").alias("v"), (F.col("event_type") == "error").alias("w"))
    return M.midrank_auc(v, "v", "w").select(F.round("auc", 9).alias("auc"), "n_within", "n_null")


@query("confusion_metrics", "WITH r AS (SELECT o_orderpriority AS g, CASE WHEN o_totalprice > 200000 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN '2-HIGH' ELSE o_orderpriority END AS p FROM orders), l AS (SELECT DISTINCT g AS x FROM r UNION SELECT p FROM r), e AS (SELECT x, (SELECT count(*) FROM r WHERE g = x) AS gold, (SELECT count(*) FROM r WHERE p = x) AS pred, (SELECT count(*) FROM r WHERE g = x AND p = x) AS hit FROM l), s AS (SELECT sum(gold) AS n, sum(hit) AS hit, avg(CASE WHEN gold + pred > 0 THEN 2.0::DOUBLE * hit / (gold + pred) ELSE 0 END) AS f, sum(gold * pred)::DOUBLE / (sum(gold) * sum(gold)) AS c FROM e) SELECT round((hit / n)::DOUBLE, 9) AS accuracy, round(f, 9) AS macro_f1, round((hit / n - c) / (1 - c), 9) AS kappa FROM s")
def confusion_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.when(F.col("o_totalprice") > 200000, "1-URGENT").when(F.col("o_totalprice") > 100000, "2-HIGH").otherwise(F.col("o_orderpriority"))
    out = M.confusion_metrics(o.select(F.col("o_orderpriority").alias("g"), p.alias("p")), "g", "p")
    return out.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "kappa")])


_DIRECTED = "l AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src % 5 = 0 THEN '<->' WHEN src < dst THEN '->' ELSE '<-' END AS d FROM mesh WHERE src % 7 <> 0), r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN dst % 4 = 0 THEN '<->' WHEN dst % 4 = 1 THEN '<-' ELSE '->' END AS d FROM mesh WHERE src % 6 <> 0)"


@query("compare_directions", "WITH " + MESH_SQL + ", " + _DIRECTED + " SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, l.d AS left_direction, r.d AS right_direction, CASE WHEN r.d IS NULL THEN 'left_only' WHEN l.d IS NULL THEN 'right_only' WHEN l.d = r.d THEN 'agree' WHEN l.d <> '<->' AND r.d <> '<->' THEN 'reversed' WHEN l.d = '<->' THEN 'bidirectional_to_directed' ELSE 'directed_to_bidirectional' END AS change FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b")
def compare_directions(spark, sf_dir):
    e = mesh(spark, sf_dir)
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    left = e.where("src % 7 <> 0").select(*pair, F.when(F.col("src") % 5 == 0, "<->").when(F.col("src") < F.col("dst"), "->").otherwise("<-").alias("direction"))
    right = e.where("src % 6 <> 0").select(*pair, F.when(F.col("dst") % 4 == 0, "<->").when(F.col("dst") % 4 == 1, "<-").otherwise("->").alias("direction"))
    return M.compare_directions(left, right)


@query("compare_downstream", "WITH RECURSIVE " + TREE_SQL + ", l(src, dst, hop) AS (SELECT src, dst, 1 FROM tree UNION ALL SELECT l.src, t.dst, hop + 1 FROM l JOIN tree t ON l.dst = t.src WHERE hop < 3), r AS (SELECT src, dst, CASE WHEN dst % 10 = 0 THEN hop + 1 ELSE hop END AS hop FROM l WHERE src % 9 <> 0) SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, count(*) AS n_common, (SELECT count(*) FROM l) + (SELECT count(*) FROM r) - count(*) AS n_union, count(*) FILTER (WHERE l.hop <> r.hop) AS hop_differs, round(count(*)::DOUBLE / ((SELECT count(*) FROM l) + (SELECT count(*) FROM r) - count(*)), 9) AS jaccard FROM l JOIN r ON l.src = r.src AND l.dst = r.dst")
def compare_downstream(spark, sf_dir):
    from cascata.operators.graph import reach

    left = reach(tree(spark, sf_dir), 3, "downstream")
    right = left.where("src % 9 <> 0").withColumn("hop", F.when(F.col("dst") % 10 == 0, F.col("hop") + 1).otherwise(F.col("hop")))
    return M.compare_hops(left, right).withColumn("jaccard", F.round("jaccard", 9))


@query("native_groups", "WITH {alarms}, " + GROUPS_SQL + " SELECT group_id, count(*) AS alarms, count(DISTINCT ne) AS sources, count(DISTINCT site) AS sites, count(DISTINCT kind) AS kinds FROM grp GROUP BY group_id HAVING count(*) FILTER (WHERE ne % 50 = 0) = 0 AND count(*) >= 4 AND count(DISTINCT ne) >= 3 AND count(DISTINCT site) >= 2")
def native_groups(spark, sf_dir):
    g = groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("alarms"), F.countDistinct("ne").alias("sources"), F.countDistinct("site").alias("sites"), F.countDistinct("kind").alias("kinds"), F.count_if(F.col("ne") % 50 == 0).alias("_excluded"))
    return g.where("_excluded = 0 and alarms >= 4 and sources >= 3 and sites >= 2").drop("_excluded")


@query("top_groups", "WITH {alarms}, " + GROUPS_SQL + ", g AS (SELECT group_id, count(*) AS alarms, count(DISTINCT ne) AS sources, count(DISTINCT site) AS sites, string_agg(DISTINCT CAST(site AS VARCHAR), ',' ORDER BY CAST(site AS VARCHAR)) AS sig FROM grp GROUP BY group_id HAVING count(DISTINCT site) >= 2), u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sig ORDER BY alarms DESC, group_id) = 1) SELECT group_id, sites, sources, alarms FROM u ORDER BY sites DESC, sources DESC, alarms DESC, group_id LIMIT 20")
def top_groups(spark, sf_dir):
    """The feature is a top-k report: groups with one signature of sites count once."""
    g = groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("alarms"), F.countDistinct("ne").alias("sources"), F.countDistinct("site").alias("sites"), F.array_join(F.array_sort(F.collect_set(F.col("site").cast("string"))), ",").alias("sig"))
    one = g.where("sites >= 2").withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("alarms"), "group_id"))).where("_r = 1")
    return one.orderBy(F.desc("sites"), F.desc("sources"), F.desc("alarms"), "group_id").limit(20).select("group_id", "sites", "sources", "alarms")


@query("ultimate_groups", "WITH {alarms}, " + GROUPS_SQL + ", rel AS (SELECT DISTINCT group_id, kind || '-' || split_part(group_id, '-', 2) || '-' || CAST(CAST(split_part(group_id, '-', 3) AS BIGINT) - 1 AS VARCHAR) AS related FROM grp WHERE ts % 3 = 0) SELECT DISTINCT group_id FROM grp WHERE group_id NOT IN (SELECT related FROM rel)")
def ultimate_groups(spark, sf_dir):
    g = groups(spark, sf_dir)
    part = F.split("group_id", "-")
    related = g.where("ts % 3 = 0").select(F.concat_ws("-", "kind", part[1], (part[2].cast("long") - 1).cast("string")).alias("group_id")).distinct()
    return g.select("group_id").distinct().join(related, "group_id", "left_anti")


@query("health_score", "WITH {alarms}, " + GROUPS_SQL + ", n AS (SELECT group_id, count(*) AS n, (max(ts) - min(ts)) / 1000000.0::DOUBLE AS d FROM grp GROUP BY group_id), s AS (SELECT list_sort(list(n)) AS a, list_sort(list(d)) AS b, count(*) AS t, avg((n <= 1)::INT) AS single FROM n), v AS (SELECT t, single, a[CAST(floor(50 * (t - 1) / 100) AS BIGINT) + 1] AS p50, a[CAST(floor(90 * (t - 1) / 100) AS BIGINT) + 1] AS p90, a[CAST(floor(99 * (t - 1) / 100) AS BIGINT) + 1] AS p99, b[CAST(floor(90 * (t - 1) / 100) AS BIGINT) + 1] AS span FROM s) SELECT t AS groups, round(0.30 * 60 + 0.20 * 100 * exp(-span / 3600) + 0.15 * 100 * (0.35 * least(p50 / 2.0::DOUBLE, 1) + 0.40 * exp(-greatest(0, p90 - 20) / 20.0::DOUBLE) + 0.25 * exp(-greatest(0, p99 - 100) / 100.0::DOUBLE)) + 0.15 * 100 * (1 - single) + 0.10 * 100 * exp(-0.1::DOUBLE / 0.2) + 0.10 * 95, 6) AS health FROM v")
def health_score(spark, sf_dir):
    profile = groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("events"), ((F.max("ts") - F.min("ts")) / 1e6).alias("duration_s"))
    out = M.health(profile, F.lit(0.6), F.lit(0.1), F.lit(0.05))
    return out.select("groups", F.round("health", 6).alias("health"))


@query("clear_health", "WITH {alarms}, c AS (SELECT ne, site, ts, kind = 'clear' AS cleared, count(*) FILTER (WHERE kind = 'clear') OVER (PARTITION BY ts // 3600000000) >= 4 AS bulk FROM alarms), g AS (SELECT site, count(*) FILTER (WHERE cleared) / count(*)::DOUBLE AS coverage, count(*) FILTER (WHERE cleared AND bulk) AS b, count(*) FILTER (WHERE cleared) AS n FROM c GROUP BY site) SELECT site, round(coverage, 9) AS coverage, round((0.15 * 100 * coverage + 0.15 * 100 * (1 - b / n::DOUBLE)) / 0.30, 6) AS health FROM g WHERE n > 0")
def clear_health(spark, sf_dir):
    from cascata.operators.intervals import bulk_windows

    a = alarms(spark, sf_dir)
    cleared = bulk_windows(a.where("kind = 'clear'"), "ts", 3_600_000_000, 4).groupBy("site").agg(F.count("*").alias("n"), F.count_if("bulk").alias("b"))
    g = a.groupBy("site").agg(F.count("*").alias("t")).join(cleared, "site")
    coverage = F.col("n") / F.col("t")
    none = F.lit(None).cast("double")
    score = M.clear_health({"separation": none, "compactness": none, "coverage": 100 * coverage, "bulk": 100 * (1 - F.col("b") / F.col("n"))})
    return g.select("site", F.round(coverage, 9).alias("coverage"), F.round(score, 6).alias("health"))
