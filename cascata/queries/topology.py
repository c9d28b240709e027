"""Queries of graph building, anchors, lookups and ticket bounds. Suppliers are elements, nations sites; events are alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cascata.operators import graph as G
from cascata.operators import lookups as K
from cascata.operators import metrics as M
from cascata.operators import topology as T
from cascata.queries.evaluation import GROUPS_SQL, TICKETS_SQL, groups, tickets
from cascata.queries.graphs import MESH_SQL, mesh
from cascata.queries.registry import alarms, query
from cascata.session import table

_DOMAIN = "CASE s_suppkey % 4 WHEN 0 THEN 'RAN' WHEN 1 THEN 'TRANSMISSION' WHEN 2 THEN 'DATA' ELSE 'OTHER' END"
_EL = f"el AS (SELECT s_suppkey AS ne, s_nationkey AS site, {_DOMAIN} AS domain FROM supplier)"


def elements(spark, sf_dir):
    k = F.col("s_suppkey")
    domain = F.when(k % 4 == 0, "RAN").when(k % 4 == 1, "TRANSMISSION").when(k % 4 == 2, "DATA").otherwise("OTHER")
    return table(spark, sf_dir, "supplier").select(k.alias("ne_id"), F.col("s_nationkey").alias("site"), domain.alias("domain"))


def raw_links(spark, sf_dir):
    e = mesh(spark, sf_dir)
    layer = F.when(F.col("src") % 3 == 0, "eth").otherwise("Eth ")
    there = e.select(F.concat(F.lit(" ne"), "src").alias("a_ne"), F.concat(F.lit("NE"), "dst").alias("z_ne"), layer.alias("layer"))
    back = e.where("src % 2 = 0").select(F.concat(F.lit("ne"), "dst").alias("a_ne"), F.concat(F.lit("ne"), "src").alias("z_ne"), F.lit("ETH").alias("layer"))
    return there.unionByName(back).unionByName(e.limit(0).select(F.lit("").alias("a_ne"), F.lit("x").alias("z_ne"), F.lit("ETH").alias("layer")))


_GRAPH = """w AS (SELECT 'NE' || src AS s, 'NE' || dst AS d, 1 AS o FROM mesh UNION ALL SELECT 'NE' || dst, 'NE' || src, 0 FROM mesh
  UNION ALL SELECT 'NE' || dst, 'NE' || src, 1 FROM mesh WHERE src % 2 = 0 UNION ALL SELECT 'NE' || src, 'NE' || dst, 0 FROM mesh WHERE src % 2 = 0),
graph AS (SELECT s AS src, d AS dst, 'ETH' AS layer, CASE WHEN min(o) <> max(o) THEN '<->' WHEN max(o) = 1 THEN '->' ELSE '<-' END AS direction FROM w GROUP BY s, d)"""


@query("ne_graph_build", "WITH " + MESH_SQL + ", " + _GRAPH + " SELECT * FROM graph")
def ne_graph_build(spark, sf_dir):
    return T.ne_graph(raw_links(spark, sf_dir))


@query(
    "downstream_site_topology",
    "WITH " + MESH_SQL + ", " + _GRAPH + """, p AS (SELECT 'NE' || s_suppkey AS ne, CAST(s_nationkey AS VARCHAR) AS site FROM supplier),
d AS (SELECT a.site, b.site AS downstream FROM graph JOIN p a ON a.ne = src JOIN p b ON b.ne = dst WHERE a.site <> b.site AND contains(direction, '<-')
  UNION SELECT b.site, a.site FROM graph JOIN p a ON a.ne = src JOIN p b ON b.ne = dst WHERE a.site <> b.site AND contains(direction, '->'))
SELECT DISTINCT p.site, downstream FROM p LEFT JOIN d ON d.site = p.site""",
)
def downstream_site_topology(spark, sf_dir):
    ne_site = elements(spark, sf_dir).select(F.concat(F.lit("NE"), "ne_id").alias("ne_id"), F.col("site").cast("string").alias("site_id"))
    return T.downstream_sites(T.ne_graph(raw_links(spark, sf_dir)), ne_site)


@query("region_graph", "WITH " + MESH_SQL + ", k AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3, 4, 5, 6)) SELECT src, dst FROM mesh WHERE src IN (FROM k) AND dst IN (FROM k)")
def region_graph(spark, sf_dir):
    return T.within_regions(elements(spark, sf_dir).withColumnRenamed("site", "region"), mesh(spark, sf_dir), [1, 2, 3, 4, 5, 6])[1]


@query("modelled_domains", "WITH {alarms}, " + _EL + " SELECT kind, coalesce(domain, 'UNKNOWN_DEVICE') AS domain, coalesce(domain, '') IN ('RAN', 'TRANSMISSION', 'DATA') AS modelled, count(*) AS n FROM alarms LEFT JOIN el USING (ne) GROUP BY 1, 2, 3")
def modelled_domains(spark, sf_dir):
    return T.with_domain(alarms(spark, sf_dir), elements(spark, sf_dir)).groupBy("kind", "domain", "modelled").agg(F.count("*").alias("n"))


@query("neighbours_in_sites", "WITH " + MESH_SQL + ", k AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT src, dst FROM both_ways WHERE src IN (FROM k) AND dst IN (FROM k)")
def neighbours_in_sites(spark, sf_dir):
    e = mesh(spark, sf_dir)
    both = e.union(e.select("dst", "src")).distinct()
    return T.links_within(both, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))).select("src", "dst")


_ROLE = "CASE s_suppkey % 3 WHEN 0 THEN 'router' WHEN 1 THEN 'wireless' ELSE 'transport' END"


@query(
    "eligible_site_links",
    "WITH " + MESH_SQL + f""", r AS (SELECT s_suppkey AS ne, s_suppkey % 50 AS site, {_ROLE} AS role, 'd' || (s_suppkey % 5) AS domain FROM supplier),
o AS (SELECT site FROM r GROUP BY site HAVING bool_and(role = 'wireless'))
SELECT src, dst FROM mesh JOIN r a ON a.ne = src JOIN r b ON b.ne = dst
WHERE a.domain = b.domain OR (a.site IN (FROM o) AND a.role = 'wireless' AND b.role IN ('wireless', 'router')) OR (b.site IN (FROM o) AND b.role = 'wireless' AND a.role IN ('wireless', 'router'))""",
)
def eligible_site_links(spark, sf_dir):
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("ne"), (k % 50).alias("site"), F.when(k % 3 == 0, "router").when(k % 3 == 1, "wireless").otherwise("transport").alias("role"), F.concat(F.lit("d"), k % 5).alias("domain"))
    r = r.join(T.wireless_only_sites(r).withColumn("only", F.lit(True)), "site", "left").withColumn("only", F.coalesce("only", F.lit(False)))
    a, b = (r.select(*[F.col(c).alias(f"{s}_{c}") for c in ("ne", "role", "domain", "only")]) for s in "ab")
    placed = mesh(spark, sf_dir).join(a, F.col("src") == F.col("a_ne")).join(b, F.col("dst") == F.col("b_ne"))
    return placed.where(T.eligible_link(*[F.col(c) for c in ("a_domain", "b_domain", "a_role", "b_role", "a_only", "b_only")])).select("src", "dst")


@query(
    "isolated_sites",
    "WITH " + MESH_SQL + """, e AS (SELECT s_suppkey AS ne, s_suppkey // 3 AS site, CASE WHEN s_suppkey % 2 = 0 THEN 'TRANSMISSION' ELSE 'DATA' END AS domain FROM supplier),
l AS (SELECT src, dst FROM both_ways WHERE abs(src - dst) < 3 OR src % 7 = 0),
o AS (SELECT a.site FROM l JOIN e a ON a.ne = src LEFT JOIN e b ON b.ne = dst WHERE src <> dst AND (b.site IS NULL OR b.site <> a.site))
SELECT site, count(*) AS elements FROM e WHERE domain = 'TRANSMISSION' AND site NOT IN (FROM o) GROUP BY site""",
)
def isolated_sites(spark, sf_dir):
    k = F.col("s_suppkey")
    e = table(spark, sf_dir, "supplier").select(k.alias("ne_id"), F.floor(k / 3).alias("site"), F.when(k % 2 == 0, "TRANSMISSION").otherwise("DATA").alias("domain"))
    m = mesh(spark, sf_dir)
    both = m.union(m.select("dst", "src")).distinct()
    return T.isolated_sites(e, both.where("abs(src - dst) < 3 or src % 7 = 0"))


@query("site_device_counts", "WITH " + _EL + " SELECT site, count(*) FILTER (WHERE domain = 'RAN') AS ran, count(*) FILTER (WHERE domain = 'TRANSMISSION') AS transmission, count(*) FILTER (WHERE domain = 'DATA') AS data FROM el GROUP BY site")
def site_device_counts(spark, sf_dir):
    counts = T.device_counts(elements(spark, sf_dir), ["RAN", "TRANSMISSION", "DATA"])
    return counts.select("site", F.col("RAN").alias("ran"), F.col("TRANSMISSION").alias("transmission"), F.col("DATA").alias("data"))


_PEERS = """ends AS (SELECT 'NE' || src AS ne, CAST(src % 10 AS VARCHAR) AS port, 'NE' || dst AS rn, CAST(dst % 10 AS VARCHAR) AS rp, src * 7 % 13 AS m FROM mesh
  UNION ALL SELECT 'NE' || dst, CAST(dst % 10 AS VARCHAR), 'NE' || src, CAST(src % 10 AS VARCHAR), src * 7 % 13 FROM mesh),
peers AS (SELECT ne, port, rn AS remote_ne, rp AS remote_port FROM ends QUALIFY row_number() OVER (PARTITION BY ne, port ORDER BY m DESC, rn DESC, rp DESC) = 1),
la AS (SELECT eid, 'ne' || ne AS ne, CAST(port % 10 AS VARCHAR) AS port, site FROM alarms WHERE kind = 'link')"""


def _peers(spark, sf_dir):
    e = mesh(spark, sf_dir)
    name, port = lambda c: F.concat(F.lit("NE"), c), lambda c: (F.col(c) % 10).cast("string")
    return T.latest_peers(e.select(name("src").alias("a_ne"), port("src").alias("a_port"), name("dst").alias("z_ne"), port("dst").alias("z_port"), (F.col("src") * 7 % 13).alias("modified")))


def _link_alarms(spark, sf_dir):
    a = alarms(spark, sf_dir).where("kind = 'link'")
    return a.select("eid", F.concat(F.lit("ne"), "ne").alias("ne"), (F.col("port") % 10).cast("string").alias("port"), "site")


@query("link_endpoints", "WITH {alarms}, " + MESH_SQL + ", " + _PEERS + " SELECT eid, la.ne, la.port, remote_ne, remote_port FROM la LEFT JOIN peers ON peers.ne = upper(la.ne) AND peers.port = la.port")
def link_endpoints(spark, sf_dir):
    return T.endpoints(_link_alarms(spark, sf_dir), _peers(spark, sf_dir)).select("eid", "ne", "port", "remote_ne", "remote_port")


@query("link_peer_on_site", "WITH {alarms}, " + MESH_SQL + ", " + _PEERS + " SELECT eid, remote_ne FROM la JOIN peers ON peers.ne = upper(la.ne) AND peers.port = la.port JOIN supplier ON 'NE' || s_suppkey = remote_ne WHERE s_nationkey % 5 = site % 5")
def link_peer_on_site(spark, sf_dir):
    sites = elements(spark, sf_dir).select(F.concat(F.lit("NE"), "ne_id").alias("ne_id"), (F.col("site") % 5).alias("site_id"))
    return T.peer_on_site(_link_alarms(spark, sf_dir).withColumn("related_site", F.col("site") % 5), _peers(spark, sf_dir), sites).select("eid", "remote_ne")


_WALK = ", r(src, dst, hop) AS (SELECT src, dst, 1 FROM both_ways UNION SELECT r.src, b.dst, hop + 1 FROM r JOIN both_ways b ON r.dst = b.src WHERE hop < 2) "


@query(
    "near_anchor_events",
    "WITH RECURSIVE {alarms}, " + MESH_SQL + _WALK + """, near AS (SELECT DISTINCT s_nationkey AS anchor, dst AS ne FROM supplier JOIN r ON r.src = s_suppkey UNION SELECT s_nationkey, s_suppkey FROM supplier)
SELECT eid, site AS anchor_site, ne FROM alarms WHERE kind = 'offline' AND (site, ne) IN (SELECT anchor, ne FROM near)""",
)
def near_anchor_events(spark, sf_dir):
    events = alarms(spark, sf_dir).where("kind = 'offline'").select("eid", F.col("site").alias("anchor_site"), "ne")
    return T.near_anchor(events, elements(spark, sf_dir).select("ne_id", F.col("site").alias("site_id")), mesh(spark, sf_dir), 2).select("eid", "anchor_site", "ne")


@query("mutual_anchor_pairs", "WITH RECURSIVE " + MESH_SQL + _WALK + ", p AS (SELECT a.s_suppkey AS l, b.s_suppkey AS q FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey % 5 = 0 WHERE a.s_suppkey % 3 = 0) SELECT l AS left_ne, q AS right_ne FROM p WHERE l = q OR (l, q) IN (SELECT src, dst FROM r)")
def mutual_anchor_pairs(spark, sf_dir):
    s = elements(spark, sf_dir)
    left, right = s.where("ne_id % 3 = 0").select("site", F.col("ne_id").alias("left_ne")), s.where("ne_id % 5 = 0").select("site", F.col("ne_id").alias("right_ne"))
    return T.mutual_pairs(left.join(right, "site").select("left_ne", "right_ne"), mesh(spark, sf_dir), 2)


@query("nth_neighbours", "WITH RECURSIVE " + MESH_SQL + ", r(node, d) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 9000 UNION SELECT dst, d + 1 FROM r JOIN both_ways ON src = node WHERE d < 2) SELECT node FROM r GROUP BY node HAVING min(d) = 2")
def nth_neighbours(spark, sf_dir):
    return T.nth_neighbours(mesh(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node")), 2)


@query(
    "chain_tree",
    "WITH RECURSIVE " + MESH_SQL + """, st AS (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 9000), r(src, dst, hop) AS (SELECT s, s, 0 FROM st UNION SELECT r.src, m.dst, hop + 1 FROM r JOIN mesh m ON m.src = r.dst WHERE hop < 3),
b AS (SELECT src, dst, min(hop) AS hop FROM r GROUP BY src, dst)
SELECT b.src AS start, b.dst AS node, b.hop, min(m.src) AS parent FROM b JOIN mesh m ON m.dst = b.dst JOIN b p ON p.src = b.src AND p.dst = m.src AND p.hop = b.hop - 1 WHERE b.hop > 0 GROUP BY 1, 2, 3""",
)
def chain_tree(spark, sf_dir):
    return T.chain_tree(mesh(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("node")), 3)


@query(
    "component_adjacency",
    "WITH RECURSIVE " + MESH_SQL + _WALK + """, m AS (SELECT DISTINCT c_custkey // 5 AS c, c_custkey % (SELECT max(s_suppkey) FROM supplier) AS site FROM customer WHERE c_acctbal > 9000),
close AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 4, a.s_suppkey - 4)),
e AS (SELECT x.c AS l, y.c AS q, 0 AS k FROM m x JOIN m y USING (site) WHERE x.c < y.c
  UNION ALL SELECT x.c, y.c, 1 FROM m x JOIN r ON r.src = x.site JOIN m y ON y.site = r.dst WHERE x.c < y.c AND r.src <> r.dst UNION ALL SELECT x.c, y.c, 2 FROM m x JOIN close ON close.src = x.site JOIN m y ON y.site = close.dst WHERE x.c < y.c)
SELECT l AS left, q AS right, ['shared_site', 'hop', 'distance'][min(k) + 1] AS reason FROM e GROUP BY l, q""",
)
def component_adjacency(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    most = s.agg(F.max("src").alias("most"))
    m = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(F.broadcast(most)).select(F.floor(F.col("c_custkey") / 5).alias("component"), (F.col("c_custkey") % F.col("most")).alias("site"))
    close = s.select("src", (F.col("src") + 4).alias("dst")).join(s.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return T.component_adjacency(m, mesh(spark, sf_dir), 2, close)


@query("groups_by_id", "WITH {alarms}, " + GROUPS_SQL + " SELECT group_id, eid, ts FROM grp WHERE group_id LIKE 'link-1-%' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ts, eid) = 1")
def groups_by_id(spark, sf_dir):
    g = groups(spark, sf_dir).select("group_id", "eid", "ts")
    return K.by_id(g, "group_id", g.where("group_id like 'link-1-%'").select("group_id"), F.struct("ts", "eid"))


@query("groups_with_high_value", "WITH {alarms}, g AS (SELECT eid, value, CAST(site AS VARCHAR) || '-' || CAST(ts // 3600000000 AS VARCHAR) AS group_id FROM alarms) SELECT group_id, count(*) AS n FROM g WHERE group_id IN (SELECT group_id FROM g WHERE value > 300) GROUP BY group_id")
def groups_with_high_value(spark, sf_dir):
    g = alarms(spark, sf_dir).withColumn("group_id", F.concat_ws("-", "site", F.floor(F.col("ts") / 3_600_000_000)))
    return K.groups_with(g, "group_id", F.col("value") > 300).groupBy("group_id").agg(F.count("*").alias("n"))


@query("distinct_field_values", "SELECT unnest(string_split(p_name, ' ')) AS value, count(*) AS n FROM part GROUP BY 1")
def distinct_field_values(spark, sf_dir):
    return K.distinct_values(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("listed_names", "SELECT o_custkey AS c_custkey, count(*) AS n, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS is_present FROM orders GROUP BY o_custkey")
def listed_names(spark, sf_dir):
    return K.listed(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("enriched_symptoms", "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + ", m AS (SELECT eid, site, min(ticket) AS ticket FROM tick GROUP BY eid, site) SELECT group_id, grp.eid, ticket FROM grp LEFT JOIN m ON m.eid = grp.eid AND m.site = grp.site")
def enriched_symptoms(spark, sf_dir):
    return K.enriched(groups(spark, sf_dir).select("group_id", "eid", "site"), tickets(spark, sf_dir).select("eid", "site", "ticket"), ["eid", "site"]).select("group_id", "eid", "ticket")


@query(
    "topology_cohesion",
    "WITH {alarms}, " + GROUPS_SQL + """, m AS (SELECT DISTINCT group_id, ne, site FROM grp WHERE ts // 86400000000 % 9 = 0),
p AS (SELECT a.group_id, CASE WHEN a.site = b.site THEN 'same_site' WHEN a.ne % 7 = b.ne % 7 THEN 'direct' WHEN a.ne % 2 = b.ne % 2 THEN 'indirect' ELSE 'odd' END AS relation FROM m a JOIN m b ON a.group_id = b.group_id AND a.ne < b.ne)
SELECT group_id, count(*) AS pairs, round(sum(CASE relation WHEN 'same_site' THEN 0.75::DOUBLE WHEN 'direct' THEN 0.9::DOUBLE WHEN 'indirect' THEN 0.5::DOUBLE ELSE 0 END) / count(*), 9) AS cohesion FROM p GROUP BY group_id""",
)
def topology_cohesion(spark, sf_dir):
    m = groups(spark, sf_dir).where("floor(ts / 86400000000) % 9 = 0").select("group_id", "ne", "site").distinct()
    a, b = m.alias("a"), m.alias("b")
    relation = F.when(F.col("a.site") == F.col("b.site"), "same_site").when(F.col("a.ne") % 7 == F.col("b.ne") % 7, "direct").when(F.col("a.ne") % 2 == F.col("b.ne") % 2, "indirect").otherwise("odd")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.ne") < F.col("b.ne"))).select(F.col("a.group_id").alias("group_id"), relation.alias("relation"))
    return K.cohesion(pairs, "group_id").withColumn("cohesion", F.round("cohesion", 9))


_BOUND = """win AS (SELECT ticket, min(ts) - 60000000 AS start_ts, max(ts) + 60000000 AS end_ts FROM tick GROUP BY ticket),
target AS (SELECT DISTINCT ticket, (site + k) % 25 AS site FROM tick, (VALUES (0), (1)) v(k)),
direct AS (SELECT DISTINCT ticket, site FROM tick),
inferred AS (SELECT DISTINCT t.ticket, t.site FROM target t JOIN win USING (ticket) JOIN alarms a ON a.site = t.site AND a.ts BETWEEN start_ts AND end_ts)"""


def _ticket_parts(spark, sf_dir):
    t = tickets(spark, sf_dir)
    windows = t.groupBy("ticket").agg((F.min("ts") - 60_000_000).alias("start_ts"), (F.max("ts") + 60_000_000).alias("end_ts"))
    target = t.select("ticket", F.explode(F.array(F.col("site"), (F.col("site") + 1) % 25)).alias("site")).distinct()
    return t, windows, target, t.select("ticket", "site").distinct()


@query("ticket_window_sites", "WITH {alarms}, " + TICKETS_SQL + ", " + _BOUND + " SELECT ticket, site FROM inferred")
def ticket_window_sites(spark, sf_dir):
    _, windows, target, _ = _ticket_parts(spark, sf_dir)
    return K.in_ticket_windows(alarms(spark, sf_dir), target, windows)


_BOUND_ROWS = """bound AS (SELECT t.ticket, count(*) AS sites, count(d.site) AS direct, count(i.site) AS inferred, count(coalesce(d.site, i.site)) AS associated
  FROM target t LEFT JOIN direct d ON d.ticket = t.ticket AND d.site = t.site LEFT JOIN inferred i ON i.ticket = t.ticket AND i.site = t.site GROUP BY t.ticket)"""


def _bounds(spark, sf_dir):
    _, windows, target, direct = _ticket_parts(spark, sf_dir)
    return K.upper_bound(target, direct, K.in_ticket_windows(alarms(spark, sf_dir), target, windows))


@query("recall_upper_bound", "WITH {alarms}, " + TICKETS_SQL + ", " + _BOUND + ", " + _BOUND_ROWS + " SELECT ticket, sites, direct, inferred, associated, associated / sites::DOUBLE AS recall, CASE WHEN associated > 0 THEN 1.0::DOUBLE ELSE 0 END AS precision, round(CASE WHEN associated > 0 THEN 2 * (associated / sites::DOUBLE) / (1 + associated / sites::DOUBLE) ELSE 0 END, 9) AS f1 FROM bound")
def recall_upper_bound(spark, sf_dir):
    return _bounds(spark, sf_dir).withColumn("f1", F.round("f1", 9))


_PRED = "pred AS (SELECT DISTINCT ticket, g2.site FROM tick JOIN grp g1 USING (eid) JOIN grp g2 ON g1.group_id = g2.group_id), real AS (SELECT t.ticket, count(p.site) / count(*)::DOUBLE AS recall FROM target t LEFT JOIN pred p ON p.ticket = t.ticket AND p.site = t.site GROUP BY t.ticket)"


def _real(spark, sf_dir):
    t, _, target, _ = _ticket_parts(spark, sf_dir)
    g = groups(spark, sf_dir)
    found = K.groups_by_evidence(t, g).join(g.select("group_id", "site").distinct(), "group_id").select("ticket", "site").distinct()
    return M.site_metrics(target, found, "ticket", "site").select("ticket", "recall")


@query("recall_combined", "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + ", " + _BOUND + ", " + _BOUND_ROWS + ", " + _PRED + " SELECT ticket, real.recall AS output_recall, associated / sites::DOUBLE AS bound_recall FROM real FULL JOIN bound USING (ticket)")
def recall_combined(spark, sf_dir):
    return K.combined_recall(_real(spark, sf_dir), _bounds(spark, sf_dir), ("output", "bound"))


@query("recall_fully_associable", "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + ", " + _BOUND + ", " + _BOUND_ROWS + ", " + _PRED + " SELECT ticket, recall FROM real WHERE ticket IN (SELECT ticket FROM bound WHERE associated = sites)")
def recall_fully_associable(spark, sf_dir):
    return K.fully_associable(_real(spark, sf_dir), _bounds(spark, sf_dir))


@query("groups_by_windows", "WITH {alarms}, " + GROUPS_SQL + ", " + TICKETS_SQL + ", " + _BOUND + " SELECT DISTINCT t.ticket, group_id FROM target t JOIN win USING (ticket) JOIN grp ON grp.site = t.site AND grp.ts BETWEEN start_ts AND end_ts WHERE (t.ticket, group_id) NOT IN (SELECT ticket, group_id FROM tick JOIN grp USING (eid))")
def groups_by_windows(spark, sf_dir):
    t, windows, target, _ = _ticket_parts(spark, sf_dir)
    g = groups(spark, sf_dir)
    return K.groups_by_windows(windows, target, g, K.groups_by_evidence(t, g))


_GOLD = "a AS (SELECT DISTINCT 'g' || (ne % 40) AS g, ne % 100 AS site FROM alarms WHERE kind = 'offline'), b AS (SELECT DISTINCT 'p' || (ne % 30) AS g, ne % 100 AS site FROM alarms WHERE kind = 'link')"
_WAY = """(SELECT '{name}' AS direction, x.g AS "group", any_value(z.h) AS best, any_value(x.n) AS n_target, coalesce(any_value(z.k), 0) AS n_hit, coalesce(any_value(z.n), 0) AS other FROM (SELECT g, count(*) AS n FROM {x} GROUP BY g) x LEFT JOIN (
  SELECT s.g, s.h, s.k, c.n FROM (SELECT {x}.g, {y}.g AS h, count(*) AS k FROM {x} JOIN {y} USING (site) GROUP BY 1, 2) s JOIN (SELECT g, count(*) AS n FROM {y} GROUP BY g) c ON c.g = s.h
  QUALIFY row_number() OVER (PARTITION BY s.g ORDER BY s.k DESC, c.n, s.h) = 1) z ON z.g = x.g GROUP BY x.g)"""


@query(
    "groups_both_directions",
    "WITH {alarms}, " + _GOLD + ", u AS (" + _WAY.format(name="gold_to_predicted", x="a", y="b") + " UNION ALL " + _WAY.format(name="predicted_to_gold", x="b", y="a")
    + """) SELECT direction, "group", best, n_target, n_hit, n_hit / n_target::DOUBLE AS recall, CASE WHEN other > 0 THEN n_hit / other::DOUBLE ELSE 0 END AS precision,
round(CASE WHEN n_hit > 0 THEN 2 * (n_hit / n_target::DOUBLE) * (n_hit / other::DOUBLE) / (n_hit / n_target::DOUBLE + n_hit / other::DOUBLE) ELSE 0 END, 9) AS f1 FROM u""",
)
def groups_both_directions(spark, sf_dir):
    named = lambda kind, mark, n: alarms(spark, sf_dir).where(F.col("kind") == kind).select(F.concat(F.lit(mark), F.col("ne") % n).alias("group"), (F.col("ne") % 100).alias("site"))
    return K.both_directions(named("offline", "g", 40), named("link", "p", 30)).withColumn("f1", F.round("f1", 9))


@query("type_vocabulary", "WITH {alarms} SELECT kind || '@' || site AS label, min(ts) AS first_ts, arg_min(eid, (ts, eid)) AS first_eid, count(*) AS n FROM alarms GROUP BY 1")
def type_vocabulary(spark, sf_dir):
    a = alarms(spark, sf_dir).withColumn("label", F.concat_ws("@", "kind", "site"))
    return K.vocabulary(a, "label", "ts", "eid").select("label", F.col("first.ts").alias("first_ts"), F.col("first.eid").alias("first_eid"), "n")


@query("topology_prior", "WITH " + MESH_SQL + " SELECT m.src, m.dst, round(1.0 / (m.src + m.dst) + 2 * 0.5 * coalesce(p.score, 0), 9) AS num FROM both_ways m LEFT JOIN (SELECT src, dst, 0.5::DOUBLE + src % 2 AS score FROM mesh) p USING (src, dst)")
def topology_prior(spark, sf_dir):
    m = mesh(spark, sf_dir)
    both = m.union(m.select("dst", "src")).distinct().withColumn("num", 1 / (F.col("src") + F.col("dst")))
    return K.with_topology_prior(both, m.withColumn("score", F.lit(0.5) + F.col("src") % 2), 2.0, 0.5).withColumn("num", F.round("num", 9))


@query(
    "incident_times",
    r"""WITH c AS (SELECT o_orderkey AS ticket, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:15:00' WHEN 1 THEN 'down since ' || strftime(o_orderdate, '%Y/%m/%d') || ' 09:30, again ' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T11:00:01' ELSE 'none' END AS t, strftime(o_orderdate, '%Y/%m/%d') || ' 09:30' AS x FROM orders)
SELECT ticket, 'note' AS "column", t AS cell_text, [x] AS times FROM c WHERE ticket % 3 = 1""",
)
def incident_times(spark, sf_dir):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    note = F.when(k % 3 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:15:00"))).when(k % 3 == 1, F.concat(F.lit("down since "), F.date_format(day, "yyyy/MM/dd"), F.lit(" 09:30, again "), F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit("T11:00:01"))).otherwise("none")
    cells = table(spark, sf_dir, "orders").select(k.alias("ticket"), F.lit("note").alias("column"), note.alias("cell_text"), F.date_format(day, "yyyyMMdd").alias("day"))
    found = K.incident_times(cells.drop("day"))
    days = cells.select(F.col("ticket").alias("t"), "day")
    kept = K.incident_times(found.join(days, F.col("ticket") == F.col("t")).select("ticket", "column", "cell_text", "day"), F.col("day"))
    return kept.select("ticket", "column", "cell_text", "times")


@query(
    "direction_flips",
    "WITH " + MESH_SQL + """, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM mesh),
x AS (SELECT *, CASE WHEN a % 2 = 0 THEN '<->' ELSE '->' END AS r, b % 3 = 0 AS bridge, a % 5 = 0 AS ring, b % 11 = 0 AS gone, CASE WHEN b % 2 = 0 THEN '->' ELSE '<->' END AS vr, b % 4 = 0 AS vb, a % 7 = 0 AS con, CASE WHEN b % 6 = 0 THEN 'global_level_gap' ELSE 'vote' END AS m FROM p)
SELECT CASE WHEN gone THEN 'removed' WHEN con THEN 'constraint_forced' WHEN ring AND NOT (b % 10 = 0) THEN 'ring_force_lost' WHEN m = 'global_level_gap' THEN 'gap_first_directed' ELSE 'voting_directed' END AS category, count(*) AS n, count(*) FILTER (WHERE NOT gone AND NOT bridge AND vb) AS bridge_flips
FROM x WHERE gone OR (r = '<->' AND vr = '->') GROUP BY 1""",
)
def direction_flips(spark, sf_dir):
    p = mesh(spark, sf_dir).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    base = p.select("a", "b", F.when(a % 2 == 0, "<->").otherwise("->").alias("relation"), (b % 3 == 0).alias("is_bridge"), (a % 5 == 0).alias("strict_ring"))
    variant = p.where(b % 11 != 0).select("a", "b", F.when(b % 2 == 0, "->").otherwise("<->").alias("relation"), (b % 4 == 0).alias("is_bridge"), (b % 10 == 0).alias("strict_ring"), (a % 7 == 0).alias("constrained"), F.lit(False).alias("ring_entry"), F.when(b % 6 == 0, "global_level_gap").otherwise("vote").alias("method"))
    return K.flips(base, variant)


@query("visible_role_sites", "WITH {alarms}, " + GROUPS_SQL + ", r AS (SELECT DISTINCT group_id, (site + k) % 25 AS site, k = 1 AS hide FROM grp, (VALUES (0), (1)) v(k)) SELECT group_id, site, CASE WHEN hide THEN 'peer' ELSE 'own' END AS role FROM r WHERE NOT hide OR (group_id, site) IN (SELECT group_id, site FROM grp)")
def visible_role_sites(spark, sf_dir):
    g = groups(spark, sf_dir).select("group_id", "site").distinct()
    peer = g.select("group_id", F.lit("peer").alias("role"), ((F.col("site") + 1) % 25).alias("site"), F.lit(True).alias("hide_if_no_alarms"))
    roles = g.select("group_id", F.lit("own").alias("role"), "site", F.lit(False).alias("hide_if_no_alarms")).unionByName(peer)
    return K.visible_roles(roles, g).select("group_id", "site", "role")


_PLACED = """e AS (SELECT s_suppkey AS ne, s_suppkey // 3 AS site, CASE s_suppkey % 5 WHEN 0 THEN 'DATA' WHEN 1 THEN 'RAN' ELSE 'TRANSMISSION' END AS domain FROM supplier WHERE s_suppkey % 5 <> 4),
x AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM mesh WHERE src <> dst),
c AS (SELECT p.site AS s, p.domain AS d, q.site AS t, q.domain AS f FROM x JOIN e p ON p.ne = a JOIN e q ON q.ne = b WHERE p.site <> q.site
  UNION ALL SELECT q.site, q.domain, p.site, p.domain FROM x JOIN e p ON p.ne = a JOIN e q ON q.ne = b WHERE p.site <> q.site)"""


def _placed(spark, sf_dir):
    k = F.col("s_suppkey")
    domain = F.when(k % 5 == 0, "DATA").when(k % 5 == 1, "RAN").otherwise("TRANSMISSION")
    return table(spark, sf_dir, "supplier").where(k % 5 != 4).select(k.alias("ne_id"), F.floor(k / 3).alias("site"), domain.alias("domain"))


@query(
    "misconnection_pairs",
    "WITH " + MESH_SQL + ", " + _PLACED + """,
k AS (SELECT site, bool_or(domain = 'DATA') AS data, bool_or(domain = 'RAN') AND bool_or(domain = 'TRANSMISSION') AS access FROM e GROUP BY site)
SELECT DISTINCT least(s, t) AS site_a, greatest(s, t) AS site_b FROM c JOIN k u ON u.site = s JOIN k v ON v.site = t WHERE u.data AND v.access AND NOT v.data
GROUP BY s, t HAVING bool_or(d = 'TRANSMISSION' OR f = 'TRANSMISSION') AND NOT bool_or((d = 'DATA' AND f = 'RAN') OR (d = 'RAN' AND f = 'DATA'))""",
)
def misconnection_pairs(spark, sf_dir):
    return T.misconnection_pairs(_placed(spark, sf_dir), mesh(spark, sf_dir))


@query(
    "core_anchors",
    "WITH " + MESH_SQL + ", " + _PLACED + """,
n AS (SELECT site, count(*) FILTER (WHERE domain = 'DATA') AS data FROM e GROUP BY site),
l AS (SELECT s, count(DISTINCT t) AS near, count(*) AS links, count(*) FILTER (WHERE d = 'DATA') AS dl, count(*) FILTER (WHERE d = 'TRANSMISSION') AS tl FROM c GROUP BY s),
z AS (SELECT n.site, n.data > 0 AS has_data, coalesce(near, 0) AS near, site % 7 AS component,
  6.0::DOUBLE * CAST(n.data > 0 AS INT) + 1.5::DOUBLE * n.data + 0.8::DOUBLE * coalesce(near, 0) + 0.6::DOUBLE * coalesce(links, 0) + 1.2::DOUBLE * coalesce(dl, 0) + 0.4::DOUBLE * coalesce(tl, 0) AS score FROM n LEFT JOIN l ON s = site),
y AS (SELECT *, bool_or(has_data) OVER (PARTITION BY component) AS any_data FROM z),
w AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, near DESC, site DESC) AS r, max(score) OVER (PARTITION BY component) AS best FROM y WHERE has_data OR NOT any_data)
SELECT component, site AS node, round(score, 6) AS score FROM w WHERE CASE WHEN any_data THEN r <= 3 AND score + 1e-9 >= 0.85 * best ELSE r = 1 END""",
)
def core_anchors(spark, sf_dir):
    scores = T.core_scores(_placed(spark, sf_dir), mesh(spark, sf_dir)).withColumn("component", F.col("node") % 7)
    return G.anchors(scores).withColumn("score", F.round("score", 6))
