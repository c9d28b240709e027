"""Link learning queries over the supplier mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from cascata.operators import learning as L
from cascata.operators import metrics as M
from cascata.operators.graph import shared_neighbours
from cascata.queries.graphs import MESH_SQL, mesh
from cascata.queries.registry import query
from cascata.session import table

_FRACTION = "('0x' || substr(md5('7::' || a || '-' || b), 1, 12))::BIGINT / 281474976710655.0::DOUBLE"
SAMPLE_SQL = MESH_SQL + f""", pos AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM mesh),
two AS (SELECT DISTINCT l.src AS a, r.dst AS b FROM both_ways l JOIN both_ways r ON l.dst = r.src WHERE l.src < r.dst AND (l.src, r.dst) NOT IN (SELECT a, b FROM pos)),
q AS (SELECT a, 2 * count(*) AS n FROM pos GROUP BY a),
neg AS (SELECT a, b, n FROM two JOIN q USING (a) QUALIFY row_number() OVER (PARTITION BY a ORDER BY {_FRACTION}, b) <= n),
samples AS (SELECT a, b, 1 AS label FROM pos UNION ALL SELECT a, b, 0 FROM neg)"""


def samples(spark, sf_dir):
    e = mesh(spark, sf_dir)
    return L.samples(e, L.candidate_pairs(e), 2, "7")


@query("link_samples", "WITH " + SAMPLE_SQL + " SELECT * FROM samples")
def link_samples(spark, sf_dir):
    return samples(spark, sf_dir)


@query("link_split", "WITH " + SAMPLE_SQL + ", f AS (SELECT *, ('0x' || substr(md5('s::' || a), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS f FROM samples) SELECT CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.85 THEN 'valid' ELSE 'test' END AS part, label, count(*) AS n FROM f GROUP BY 1, 2")
def link_split(spark, sf_dir):
    return L.split_groups(samples(spark, sf_dir), F.col("a"), "s").groupBy("part", "label").agg(F.count("*").alias("n"))


@query("standardized_features", "WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d FROM supplier WHERE s_nationkey < 15) SELECT s_suppkey, round((s_acctbal - m) / d, 6) AS balance FROM supplier, s")
def standardized_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("balance"))
    return L.standardize(s, ["balance"], F.col("s_nationkey") < 15).select("s_suppkey", F.round("balance", 6).alias("balance"))


@query("rank_metrics", "WITH r AS (SELECT (o_totalprice / 600000)::DOUBLE AS s, (o_orderpriority < '3')::INT AS l FROM orders), c AS (SELECT s, count(*) FILTER (WHERE l = 1) AS p, count(*) FILTER (WHERE l = 0) AS q FROM r GROUP BY s), w AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + q) OVER (ORDER BY s DESC) AS n FROM c) SELECT round((sum(q * (tp - p + p / 2.0::DOUBLE)) / (sum(p) * sum(q)))::DOUBLE, 9) AS roc_auc, round((sum(p * tp::DOUBLE / n) / sum(p))::DOUBLE, 9) AS average_precision, round((SELECT avg(CASE WHEN l = 1 THEN -ln(greatest(1e-12, least(1 - 1e-12, s))) ELSE -ln(1 - greatest(1e-12, least(1 - 1e-12, s))) END) FROM r), 9) AS log_loss FROM w")
def rank_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select((F.col("o_totalprice").cast("double") / 600000).alias("s"), (F.col("o_orderpriority") < "3").cast("int").alias("l"))
    return M.rank_metrics(r, "l", "s").select(*[F.round(c, 9).alias(c) for c in ("roc_auc", "average_precision", "log_loss")])


@query("threshold_grid", "WITH r AS (SELECT (o_totalprice / 600000)::DOUBLE AS s, (o_orderpriority < '3')::INT AS l FROM orders), g AS (SELECT t AS threshold, count(*) FILTER (WHERE s >= t AND l = 1) AS tp, count(*) FILTER (WHERE s >= t) AS pp, count(*) FILTER (WHERE l = 1) AS p FROM r, (VALUES (0.1::DOUBLE), (0.3), (0.5)) v(t) GROUP BY t) SELECT threshold, round(CASE WHEN pp > 0 THEN tp / pp::DOUBLE ELSE 0 END, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / pp::DOUBLE) * (tp / p::DOUBLE) / (tp / pp::DOUBLE + tp / p::DOUBLE) ELSE 0 END, 9) AS f FROM g")
def threshold_grid(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select((F.col("o_totalprice").cast("double") / 600000).alias("s"), (F.col("o_orderpriority") < "3").cast("int").alias("l"))
    return M.threshold_grid(r, "l", "s", [0.1, 0.3, 0.5]).select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query("link_ranking")
def link_ranking(spark, sf_dir):
    e = mesh(spark, sf_dir)
    s = samples(spark, sf_dir)
    features = ["common", "jaccard", "adamic_adar", "resource_allocation"]
    rows = L.split_groups(s.join(shared_neighbours(e, s), ["a", "b"]), F.col("a"), "s")
    rows = L.standardize(rows, features, F.col("part") == "train")
    model = L.train(rows.where("part = 'train'"), features, "label")
    scored = L.score(model, rows, features)
    return scored.select("a", "b", "label", "part", F.element_at("probabilities", 2).alias("score"))


@query(
    "link_features",
    "WITH " + SAMPLE_SQL + """, deg AS (SELECT src, count(*) AS d FROM both_ways GROUP BY src),
c AS (SELECT x.src AS a, y.src AS b, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / ln(CAST(d AS DOUBLE)) ELSE 0 END) AS aa, sum(1.0::DOUBLE / d) AS ra FROM both_ways x JOIN both_ways y ON x.dst = y.dst JOIN deg ON deg.src = x.dst GROUP BY x.src, y.src)
SELECT s.a, s.b, label, coalesce(common, 0) AS common, round(coalesce(common, 0)::DOUBLE / (p.d + q.d - coalesce(common, 0)), 9) AS jaccard, round(coalesce(aa, 0.0), 9) AS adamic_adar, round(coalesce(ra, 0.0), 9) AS resource_allocation
FROM samples s JOIN deg p ON p.src = s.a JOIN deg q ON q.src = s.b LEFT JOIN c ON c.a = s.a AND c.b = s.b""",
)
def link_features(spark, sf_dir):
    """Neighbour features of samples on the real graph, which doesn't hold the negatives."""
    s = samples(spark, sf_dir)
    out = s.join(shared_neighbours(mesh(spark, sf_dir), s), ["a", "b"])
    return out.select("a", "b", "label", "common", *[F.round(c, 9).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")])
