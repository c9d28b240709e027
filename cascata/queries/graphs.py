"""Topology queries. Customers form a tree (parent: key div 3); suppliers form a meshed graph (next of a nation, and 2k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascata.operators import graph as G
from cascata.operators.components import connected_components
from cascata.queries.registry import query
from cascata.session import table

TREE_SQL = "tree AS (SELECT c_custkey // 3 AS src, c_custkey AS dst FROM customer WHERE c_custkey // 3 > 0)"
MESH_SQL = """mesh AS (
  SELECT s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier QUALIFY dst IS NOT NULL
  UNION SELECT s_suppkey, s_suppkey * 2 FROM supplier WHERE s_suppkey > 0 AND s_suppkey * 2 IN (SELECT s_suppkey FROM supplier)),
both_ways AS (SELECT src, dst FROM mesh UNION SELECT dst, src FROM mesh)"""


def tree(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("src"), k.alias("dst")).where("src > 0")


def mesh(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    chain = s.select(F.col("s_suppkey").alias("src"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("dst")).where("dst is not null")
    double = s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 2).alias("dst")).join(s.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    return chain.union(double).distinct()


@query("reach_hops", "WITH RECURSIVE " + TREE_SQL + ", r(src, dst, hop) AS (SELECT src, dst, 1 FROM tree UNION ALL SELECT r.src, tree.dst, hop + 1 FROM r JOIN tree ON r.dst = tree.src WHERE hop < 4) SELECT src, dst, min(hop) AS hop FROM r GROUP BY src, dst")
def reach_hops(spark, sf_dir):
    return G.reach(tree(spark, sf_dir), 4, "downstream")


@query("reach_upstream", "WITH RECURSIVE " + TREE_SQL + ", r(src, dst, hop) AS (SELECT dst, src, 1 FROM tree UNION ALL SELECT r.src, tree.src, hop + 1 FROM r JOIN tree ON r.dst = tree.dst WHERE hop < 12) SELECT src, dst, min(hop) AS hop FROM r GROUP BY src, dst")
def reach_upstream(spark, sf_dir):
    return G.reach(tree(spark, sf_dir), 12, "upstream")


_EITHER = ", r(src, dst, hop) AS (SELECT src, dst, 1 FROM both_ways UNION SELECT r.src, b.dst, hop + 1 FROM r JOIN both_ways b ON r.dst = b.src WHERE hop < 3) "


@query("reach_either", "WITH RECURSIVE " + MESH_SQL + _EITHER + "SELECT src, dst, min(hop) AS hop FROM r WHERE src <> dst GROUP BY src, dst")
def reach_either(spark, sf_dir):
    return G.reach(mesh(spark, sf_dir), 3, "either")


@query("nearest_matching", "WITH RECURSIVE " + MESH_SQL + _EITHER + ", m AS (SELECT src, dst, min(hop) AS hop FROM r WHERE src <> dst AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY src, dst) SELECT * FROM m QUALIFY hop = min(hop) OVER (PARTITION BY src)")
def nearest_matching(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return G.nearest_matching(G.reach(mesh(spark, sf_dir), 3, "either"), low)


@query(
    "path_constrained_reach",
    "WITH RECURSIVE " + MESH_SQL + ", ok AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0), s AS (SELECT src, dst FROM both_ways WHERE dst IN (FROM ok)), r(src, dst, hop) AS (SELECT src, dst, 1 FROM s UNION SELECT r.src, s.dst, hop + 1 FROM r JOIN s ON r.dst = s.src WHERE hop < 3) SELECT src, dst, min(hop) AS hop FROM r WHERE src <> dst GROUP BY src, dst",
)
def path_constrained_reach(spark, sf_dir):
    ok = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("node"))
    return G.reach(mesh(spark, sf_dir), 3, "either", allowed=ok)


@query(
    "site_chains",
    "WITH RECURSIVE " + MESH_SQL + ", first AS (SELECT src, dst FROM mesh WHERE dst < src * 2), r(src, dst, hop) AS (SELECT src, dst, 1 FROM first UNION SELECT r.src, m.dst, hop + 1 FROM r JOIN mesh m ON r.dst = m.src WHERE hop < 4) SELECT src, dst, min(hop) AS hop FROM r WHERE src <> dst GROUP BY src, dst",
)
def site_chains(spark, sf_dir):
    edges = mesh(spark, sf_dir)
    return G.reach(edges, 4, "downstream", first_edges=edges.where("dst < src * 2"))


@query("components", "WITH RECURSIVE " + MESH_SQL + ", r(src, dst) AS (SELECT src, src FROM both_ways UNION SELECT r.src, b.dst FROM r JOIN both_ways b ON r.dst = b.src) SELECT src AS node, min(dst) AS component FROM r GROUP BY src")
def components(spark, sf_dir):
    return connected_components(mesh(spark, sf_dir))


@query("tree_roots", "WITH RECURSIVE " + TREE_SQL + ", r(node, root, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT r.node, tree.src, depth + 1 FROM r JOIN tree ON r.root = tree.dst) SELECT node, root, depth FROM r QUALIFY depth = max(depth) OVER (PARTITION BY node)")
def tree_roots(spark, sf_dir):
    k = F.col("c_custkey")
    parents = table(spark, sf_dir, "customer").select(k.alias("node"), F.when(F.floor(k / 3) > 0, F.floor(k / 3)).alias("parent"))
    return G.root_of(parents)


@query("multi_source_distance", "WITH RECURSIVE " + MESH_SQL + ", r(node, distance) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal > 8000 UNION SELECT dst, distance + 1 FROM r JOIN both_ways ON src = node WHERE distance < 6) SELECT node, min(distance) AS distance FROM r GROUP BY node")
def multi_source_distance(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("node"))
    return G.multi_source_distance(mesh(spark, sf_dir), rich, 6)


@query(
    "shared_neighbours",
    "WITH " + MESH_SQL + """, deg AS (SELECT src, count(*) AS d FROM both_ways GROUP BY src),
c AS (SELECT x.src AS a, y.src AS b, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / ln(CAST(d AS DOUBLE)) ELSE 0 END) AS aa, sum(1.0::DOUBLE / d) AS ra FROM both_ways x JOIN both_ways y ON x.dst = y.dst JOIN deg ON deg.src = x.dst GROUP BY x.src, y.src)
SELECT e.src AS a, e.dst AS b, coalesce(common, 0) AS common, round(coalesce(common, 0)::DOUBLE / (p.d + q.d - coalesce(common, 0)), 9) AS jaccard, round(coalesce(aa, 0.0), 9) AS adamic_adar, round(coalesce(ra, 0.0), 9) AS resource_allocation
FROM both_ways e JOIN deg p ON p.src = e.src JOIN deg q ON q.src = e.dst LEFT JOIN c ON c.a = e.src AND c.b = e.dst WHERE e.src < e.dst""",
)
def shared_neighbours(spark, sf_dir):
    out = G.shared_neighbours(mesh(spark, sf_dir))
    return out.select("a", "b", "common", *[F.round(c, 9).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")])


_LINKS_SQL = "links AS (SELECT DISTINCT l_suppkey AS a_ne, o_custkey AS z_ne FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"


@query(
    "site_graph_build",
    "WITH " + _LINKS_SQL + """, p AS (SELECT s_nationkey AS a, c_nationkey AS z FROM links JOIN supplier ON s_suppkey = a_ne JOIN customer ON c_custkey = z_ne WHERE s_nationkey <> c_nationkey)
SELECT least(a, z) AS src, greatest(a, z) AS dst, CASE WHEN bool_or(a < z) AND bool_or(a > z) THEN '<->' WHEN bool_or(a < z) THEN '->' ELSE '<-' END AS direction, count(*) AS links FROM p GROUP BY 1, 2""",
)
def site_graph_build(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    links = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    links = links.select(F.concat(F.lit("s"), "l_suppkey").alias("a_ne"), F.concat(F.lit("c"), "o_custkey").alias("z_ne")).distinct()
    sites = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("ne_id"), F.col("s_nationkey").alias("site_id"))
    sites = sites.union(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_nationkey"))
    return G.project_links(links, sites)


@query("bridges")
def bridges(spark, sf_dir):
    return G.bridges(mesh(spark, sf_dir))


@query("strict_rings")
def strict_rings(spark, sf_dir):
    scores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score"))
    return G.strict_rings(mesh(spark, sf_dir), scores)


@query("smooth_levels")
def smooth_levels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000).cast("double").alias("base"))
    return G.smooth_levels(s, mesh(spark, sf_dir), s.where("base > 9").select("node"), rounds=20)


@query(
    "pair_directions",
    "WITH " + MESH_SQL + """, deg AS (SELECT src AS node, count(*) AS n FROM both_ways GROUP BY src),
site AS (SELECT s_suppkey AS node, s_nationkey % 4 AS core_distance, s_acctbal / 1000 - s_nationkey % 4 AS level, s_acctbal / 1000 AS base, s_nationkey % 3 = 0 AS has_data, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS pair_data, coalesce(n, 0) AS neighbours FROM supplier LEFT JOIN deg ON node = s_suppkey),
shared AS (SELECT x.src AS a, y.src AS b, count(*) AS shared FROM both_ways x JOIN both_ways y ON x.dst = y.dst GROUP BY x.src, y.src),
v AS (SELECT e.src AS a, e.dst AS b,
  sign(r.core_distance - l.core_distance) * least(abs(r.core_distance - l.core_distance), 5.0) * 2.0 + sign(l.level - r.level) * least(abs(l.level - r.level), 5.0) * 0.8
  + sign(l.base - r.base) * least(abs(l.base - r.base), 5.0) * 0.5 + sign(l.pair_data - r.pair_data) * least(abs(l.pair_data - r.pair_data), 5.0) * 1.0
  + sign(l.neighbours - r.neighbours) * least(abs(l.neighbours - r.neighbours), 5.0) * 0.4 + 2.0 * (l.has_data::INT - r.has_data::INT) + 1.2 * ((r.neighbours = 1)::INT - (l.neighbours = 1)::INT) AS gap,
  4.5 + 0.5 * least(coalesce(shared, 0), 3) AS margin
  FROM both_ways e JOIN site l ON l.node = e.src JOIN site r ON r.node = e.dst LEFT JOIN shared ON shared.a = e.src AND shared.b = e.dst WHERE e.src < e.dst)
SELECT a, b, round(gap::DOUBLE, 6) AS gap, round(margin::DOUBLE, 6) AS margin, CASE WHEN abs(gap) < margin THEN '<->' WHEN gap > 0 THEN '->' ELSE '<-' END AS direction FROM v""",
)
def pair_directions(spark, sf_dir):
    edges = mesh(spark, sf_dir)
    degree = G.mirrored(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    n, bal = F.col("s_nationkey"), F.col("s_acctbal").cast("double") / 1000
    sites = table(spark, sf_dir, "supplier").join(degree, F.col("node") == F.col("s_suppkey"), "left").select(
        F.col("s_suppkey").alias("node"), (n % 4).alias("core_distance"), (bal - n % 4).alias("level"), bal.alias("base"), (n % 3 == 0).alias("has_data"), (n % 3 == 0).cast("int").alias("pair_data"), F.coalesce("n", F.lit(0)).alias("neighbours"),
    )
    pairs = G.shared_neighbours(edges).select("a", "b", F.col("common").alias("shared"), F.lit(False).alias("is_bridge"))
    out = G.pair_directions(pairs, sites)
    return out.select("a", "b", F.round("gap", 6).alias("gap"), F.round("margin", 6).cast("double").alias("margin"), "direction")


@query(
    "common_upstream",
    "WITH RECURSIVE " + TREE_SQL + """, up(site, root, hop) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT up.site, tree.src, hop + 1 FROM up JOIN tree ON up.root = tree.dst),
g AS (SELECT DISTINCT o_orderpriority || '-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) AS group_id, o_custkey AS site FROM orders WHERE o_totalprice > 150000 AND o_custkey // 3 > 0),
c AS (SELECT group_id, root, count(DISTINCT g.site) AS n, sum(hop) AS total, max(hop) AS far FROM g JOIN up USING (site) GROUP BY group_id, root),
k AS (SELECT c.* FROM c JOIN (SELECT group_id, count(*) AS n FROM g GROUP BY group_id) s USING (group_id) WHERE c.n = s.n)
SELECT group_id, root, total, far FROM k QUALIFY (total, far) = min((total, far)) OVER (PARTITION BY group_id)""",
)
def common_upstream(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 150000")
    d = F.col("o_orderdate").cast("date")
    groups = o.where(F.floor(F.col("o_custkey") / 3) > 0).select(F.concat_ws("-", "o_orderpriority", F.year(d), F.month(d)).alias("group_id"), F.col("o_custkey").alias("site")).distinct()
    return G.lowest_common_upstream(G.reach(tree(spark, sf_dir), None, "upstream"), groups)


@query("path_lengths", "WITH RECURSIVE " + MESH_SQL + _EITHER + ", d AS (SELECT src AS a, dst AS b, min(hop) AS hop FROM r WHERE src <> dst GROUP BY src, dst) SELECT a, b, hop FROM d WHERE hop BETWEEN 2 AND 3 AND (a, b) IN (SELECT l.s_suppkey, r.s_suppkey FROM supplier l JOIN supplier r USING (s_nationkey))")
def path_lengths(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    pairs = s.withColumnRenamed("s_suppkey", "a").join(s.withColumnRenamed("s_suppkey", "b"), "s_nationkey").where("a <> b").select("a", "b")
    return G.path_lengths(mesh(spark, sf_dir), pairs, 2, 3)


@query("layered_order", "WITH RECURSIVE " + MESH_SQL + ", r(node, layer) AS (SELECT src, 0 FROM mesh WHERE src NOT IN (SELECT dst FROM mesh) UNION SELECT dst, layer + 1 FROM r JOIN mesh ON src = node) SELECT node, max(layer) AS layer FROM r GROUP BY node")
def layered_order(spark, sf_dir):
    return G.layered_order(mesh(spark, sf_dir))
