"""Rule matching and group queries. Customers are sites in the tree; market segments give their domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from cascata.operators import groups as GR
from cascata.operators import intervals as I
from cascata.plans import rules as R
from cascata.queries.evaluation import GROUPS_SQL, groups
from cascata.queries.graphs import TREE_SQL, tree
from cascata.queries.registry import alarms, query
from cascata.session import table

_DOMAINS = "dom AS (SELECT c_custkey AS site, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'Transmission' ELSE 'Data' END AS domain FROM customer), a AS (SELECT eid, ne AS site, kind, ts FROM alarms)"


def inputs(spark, sf_dir):
    a = alarms(spark, sf_dir).select("eid", F.col("ne").alias("site"), "kind", "ts")
    c = table(spark, sf_dir, "customer")
    domain = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), "Transmission").otherwise("Data")
    return a, R.site_profile(c.select(F.col("c_custkey").alias("site"), domain.alias("domain"))), tree(spark, sf_dir)


@query("rule_self_edge", "WITH {alarms}, " + _DOMAINS + " SELECT o.eid AS trigger_eid, o.site, count(*) AS power_alarms FROM a o JOIN dom USING (site) JOIN a p ON p.site = o.site AND p.kind = 'power' AND p.ts BETWEEN o.ts - 10800000000 AND o.ts + 300000000 WHERE o.kind = 'offline' AND domain = 'Transmission' GROUP BY o.eid, o.site")
def rule_self_edge(spark, sf_dir):
    found, symptoms = R.match(R.POWER_RULE, *inputs(spark, sf_dir))
    n = symptoms.where("role = 'power_node'").groupBy("inst").agg(F.count("*").alias("power_alarms"))
    return found.join(n, "inst").select("trigger_eid", F.col("r_offline_node")[0].alias("site"), "power_alarms")


@query("rule_one_hop", "WITH {alarms}, " + _DOMAINS + ", " + TREE_SQL + " SELECT o.eid AS trigger_eid, src AS parent_site, count(*) AS link_alarms FROM a o JOIN dom d ON d.site = o.site AND d.domain = 'Transmission' JOIN tree ON dst = o.site JOIN dom p ON p.site = src AND p.domain = 'Transmission' JOIN a l ON l.site = src AND l.kind = 'link' AND abs(l.ts - o.ts) <= 3600000000 WHERE o.kind = 'offline' GROUP BY o.eid, src")
def rule_one_hop(spark, sf_dir):
    found, symptoms = R.match(R.LINK_RULE, *inputs(spark, sf_dir))
    n = symptoms.where("role = 'parent'").groupBy("inst").agg(F.count("*").alias("link_alarms"))
    return found.join(n, "inst").select("trigger_eid", F.col("r_parent")[0].alias("parent_site"), "link_alarms")


@query(
    "rule_silent_storm",
    "WITH RECURSIVE {alarms}, " + _DOMAINS + ", " + TREE_SQL + """, up(site, root, hop) AS (SELECT dst, src, 1 FROM tree UNION ALL SELECT up.site, tree.src, hop + 1 FROM up JOIN tree ON up.root = tree.dst WHERE hop < 8),
t AS (SELECT o.eid, o.ts, src AS parent FROM a o JOIN dom d ON d.site = o.site AND d.domain = 'Transmission' JOIN tree ON dst = o.site JOIN dom p ON p.site = src AND p.domain = 'Transmission' WHERE o.kind = 'offline'),
g AS (SELECT t.*, root FROM t JOIN up ON up.site = parent QUALIFY hop = min(hop) OVER (PARTITION BY eid, parent))
SELECT eid AS trigger_eid, parent AS parent_site, root AS grandparent_site FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site = root AND a.kind = 'offline' AND abs(a.ts - g.ts) <= 3600000000)""",
)
def rule_silent_storm(spark, sf_dir):
    found, _ = R.match(R.STORM_RULE, *inputs(spark, sf_dir))
    return found.select("trigger_eid", F.col("r_parent")[0].alias("parent_site"), F.explode("r_grandparent").alias("grandparent_site"))


_TWO = "m AS (SELECT 'n' || ne || '@' || (ts // 3600000000) AS group_id, eid, site, 'by_ne' AS rule FROM alarms UNION ALL SELECT 's' || site || kind || '@' || (ts // 600000000), eid, site, 'by_site' FROM alarms)"


def two_groupings(spark, sf_dir):
    a = alarms(spark, sf_dir)
    one = a.select(F.concat(F.lit("n"), "ne", F.lit("@"), F.floor(F.col("ts") / 3_600_000_000)).alias("group_id"), F.col("eid").alias("alarm_key"), "site", F.lit("by_ne").alias("rule"))
    return one.unionByName(a.select(F.concat(F.lit("s"), "site", "kind", F.lit("@"), F.floor(F.col("ts") / 600_000_000)).alias("group_id"), F.col("eid").alias("alarm_key"), "site", F.lit("by_site").alias("rule")))


@query(
    "merge_groups",
    "WITH RECURSIVE {alarms}, " + _TWO + """, near AS (SELECT DISTINCT x.group_id AS a, y.group_id AS b FROM m x JOIN m y USING (eid)),
r(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, near.b FROM r JOIN near ON near.a = r.b), c AS (SELECT a AS group_id, min(b) AS merged_id FROM r GROUP BY a)
SELECT merged_id, string_agg(DISTINCT rule, ' + ' ORDER BY rule) AS rule, count(DISTINCT site) AS sites, count(DISTINCT eid) AS alarms, count(DISTINCT group_id) AS merged_groups FROM m JOIN c USING (group_id) GROUP BY merged_id""",
)
def merge_groups(spark, sf_dir):
    g = two_groupings(spark, sf_dir)
    return GR.merge_components(g, GR.merge_by_alarm(g))


@query("group_overlap", "WITH {alarms}, " + _TWO + " SELECT x.group_id AS left_id, y.group_id AS right_id, count(*) AS shared FROM m x JOIN m y USING (eid) WHERE x.rule = 'by_ne' AND y.rule = 'by_site' GROUP BY 1, 2")
def group_overlap(spark, sf_dir):
    g = two_groupings(spark, sf_dir)
    return GR.bipartite_overlap(g.where("rule = 'by_ne'"), g.where("rule = 'by_site'"))


@query("topology_completion", "WITH {alarms}, " + GROUPS_SQL + ", s AS (SELECT DISTINCT group_id, site FROM grp), own AS (SELECT DISTINCT group_id, ne FROM grp) SELECT s.group_id, count(*) AS elements, count(*) FILTER (WHERE own.ne IS NULL) AS added FROM s JOIN customer ON c_nationkey = s.site LEFT JOIN own ON own.group_id = s.group_id AND own.ne = c_custkey GROUP BY s.group_id")
def topology_completion(spark, sf_dir):
    elements = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ne"), F.col("c_nationkey").alias("site"))
    out = GR.complete_topology(groups(spark, sf_dir), elements)
    return out.groupBy("group_id").agg(F.count("*").alias("elements"), F.count_if("topology_added").alias("added"))


@query("small_groups", "WITH {alarms}, " + GROUPS_SQL + " SELECT group_id, count(DISTINCT site) AS sites FROM grp GROUP BY group_id HAVING count(DISTINCT site) <= 2")
def small_groups(spark, sf_dir):
    return GR.by_site_count(groups(spark, sf_dir), 2)


@query("group_history_replay")
def group_history_replay(spark, sf_dir):
    w = I.sliding_windows(alarms(spark, sf_dir).where("kind = 'offline'").select("site", "eid", "ts"), "ts", 1_200_000_000, 600_000_000)
    m = w.select(F.concat_ws("@", "site", "window_start").alias("group_id"), (F.col("window_start") / 1e6).alias("ts"), F.col("eid").alias("alarm_key"))
    return GR.replay_history(m, 10_800.0)
