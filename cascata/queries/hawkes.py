"""Hawkes attribution queries: alarm kinds are the vocabulary, sites the groups, seconds / 900 the kernel time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cascata.operators import hawkes as H
from cascata.operators import intervals as I
from cascata.queries.registry import alarms, query

WINDOW_S, MOST, UNIT_S = 7200, 8, 900.0
KINDS = ("link", "offline", "power")
BETA = 1.0

EVENTS_SQL = """ev AS (SELECT eid, site, ne, kind AS dim, ts, row_number() OVER (PARTITION BY site ORDER BY ts, eid) AS seq FROM alarms WHERE kind IN ('link', 'offline', 'power'))"""
PAIRS_SQL = f"""pairs AS (
  SELECT t.eid AS t_eid, s.eid AS s_eid, t.dim AS t_dim, s.dim AS s_dim, t.seq AS t_seq, s.seq AS s_seq, (t.ts - s.ts) / {UNIT_S * 1e6}::DOUBLE AS dt
  FROM ev t JOIN ev s ON s.site = t.site AND s.seq < t.seq AND s.seq >= t.seq - {MOST} AND s.ts >= t.ts - {WINDOW_S * 1_000_000})"""
PARAMS_SQL = f"""kinds(dim, w) AS (VALUES ('link', 1), ('offline', 2), ('power', 3)),
edge AS (SELECT t.dim AS t_dim, s.dim AS s_dim, CASE WHEN t.w = s.w THEN 0.5 ELSE 0.1 * s.w END::DOUBLE AS alpha FROM kinds t, kinds s),
mu AS (SELECT dim, greatest(0.05 / 2880.0, 0.1 * ln(1 + count(*)::DOUBLE) / 2880.0)::DOUBLE AS mu FROM ev GROUP BY dim),
scored AS (SELECT pairs.*, alpha * exp(-greatest(dt, 0.0)) AS score FROM pairs JOIN edge USING (t_dim, s_dim)),
rate AS (SELECT eid, dim, mu, greatest(mu + coalesce((SELECT sum(score) FROM scored WHERE t_eid = eid), 0.0), 1e-12) AS rate FROM ev JOIN mu USING (dim))"""
BEST_SQL = """best AS (SELECT t_eid, s_eid, score FROM scored QUALIFY row_number() OVER (PARTITION BY t_eid ORDER BY score DESC, s_seq) = 1),
par AS (SELECT eid, CASE WHEN score IS NOT NULL AND NOT mu > score THEN s_eid END AS parent FROM ev JOIN mu USING (dim) LEFT JOIN best ON t_eid = eid)"""
HEAD = "WITH RECURSIVE {alarms}, " + EVENTS_SQL + ", " + PAIRS_SQL


def events(spark, sf_dir):
    rows = alarms(spark, sf_dir).where(F.col("kind").isin(*KINDS)).withColumn("dim", F.col("kind"))
    return I.sequence_events(rows, ["site"], "ts", "eid").select("eid", "site", "ne", "dim", "ts", "seq")


def pairs(ev):
    found = I.history_pairs(ev, ["site"], WINDOW_S * 1_000_000, MOST)
    kinds = lambda e: ev.select(F.col("eid").alias(f"{e}_eid"), F.col("dim").alias(f"{e}_dim"))
    out = found.join(kinds("t"), "t_eid").join(kinds("s"), "s_eid")
    return out.withColumn("dt", F.col("dt") / F.lit(UNIT_S * 1e6))


def parameters(spark, ev):
    w = {k: i + 1 for i, k in enumerate(KINDS)}
    rows = [(t, s, 0.5 if t == s else 0.1 * w[s], BETA) for t in KINDS for s in KINDS]
    return spark.createDataFrame(rows, "target string, source string, alpha double, beta double"), H.initial_mu(ev, 2880.0)


@query("history_pairs", HEAD + " SELECT t_eid, s_eid, round(dt, 6) AS dt FROM pairs")
def history_pairs(spark, sf_dir):
    return pairs(events(spark, sf_dir)).select("t_eid", "s_eid", F.round("dt", 6).alias("dt"))


@query("history_pairs_strict", "WITH {alarms}, ev AS (SELECT eid, ne, ts FROM alarms) SELECT t.eid AS t_eid, s.eid AS s_eid FROM ev t JOIN ev s ON s.ne = t.ne AND s.ts < t.ts AND s.ts >= t.ts - 86400000000 QUALIFY row_number() OVER (PARTITION BY t.eid ORDER BY s.ts DESC, s.eid DESC) <= 4")
def history_pairs_strict(spark, sf_dir):
    ev = I.sequence_events(alarms(spark, sf_dir), ["ne"], "ts", "eid")
    return I.history_pairs(ev, ["ne"], 86_400_000_000, 4, strict=True).select("t_eid", "s_eid")


@query("history_pairs_slack", "WITH {alarms}, ev AS (SELECT eid, ne, ts, row_number() OVER (PARTITION BY ne ORDER BY ts, eid) AS seq FROM alarms) SELECT t.eid AS t_eid, s.eid AS s_eid FROM ev t JOIN ev s ON s.ne = t.ne AND s.eid <> t.eid AND s.ts BETWEEN t.ts - 86400000000 AND t.ts + 7200000000 QUALIFY row_number() OVER (PARTITION BY t.eid ORDER BY abs(t.ts - s.ts), s.seq DESC) <= 3")
def history_pairs_slack(spark, sf_dir):
    ev = I.sequence_events(alarms(spark, sf_dir), ["ne"], "ts", "eid")
    return I.history_pairs(ev, ["ne"], 86_400_000_000, 3, slack=7_200_000_000).select("t_eid", "s_eid")


@query("em_initial_alpha", HEAD + ", n AS (SELECT dim, count(*) AS n FROM ev GROUP BY dim) SELECT t.dim AS target, s.dim AS source, count(t_eid) AS pairs, round((count(t_eid) + 1.0) / (s.n + 10.0)::DOUBLE, 9) AS alpha FROM n t CROSS JOIN n s LEFT JOIN pairs ON t_dim = t.dim AND s_dim = s.dim GROUP BY t.dim, s.dim, s.n")
def em_initial_alpha(spark, sf_dir):
    ev = events(spark, sf_dir)
    return H.initial_alpha(pairs(ev), ev, 10.0, 0.1).select("target", "source", "pairs", F.round("alpha", 9).alias("alpha"))


@query("em_estep", HEAD + ", " + PARAMS_SQL + " SELECT t_dim, s_dim, round(sum(score / rate), 6) AS sum_p, round(sum(score / rate * dt), 6) AS sum_p_dt FROM scored JOIN rate ON t_eid = eid GROUP BY t_dim, s_dim")
def em_estep(spark, sf_dir):
    ev = events(spark, sf_dir)
    edges, mu = parameters(spark, ev)
    by_pair, _ = H.estep_sums(ev, H.pair_scores(pairs(ev), edges), mu)
    return by_pair.select("t_dim", "s_dim", F.round("sum_p", 6).alias("sum_p"), F.round("sum_p_dt", 6).alias("sum_p_dt"))


@query("em_self_and_likelihood", HEAD + ", " + PARAMS_SQL + " SELECT dim, count(*) AS n, round(sum(mu / rate), 6) AS sum_self, round(sum(ln(rate)), 5) AS sum_log_rate FROM rate GROUP BY dim")
def em_self_and_likelihood(spark, sf_dir):
    ev = events(spark, sf_dir)
    edges, mu = parameters(spark, ev)
    _, by_dim = H.estep_sums(ev, H.pair_scores(pairs(ev), edges), mu)
    return by_dim.select("dim", "n", F.round("sum_self", 6).alias("sum_self"), F.round("sum_log_rate", 5).alias("sum_log_rate"))


@query("edge_pruning", HEAD + ", n AS (SELECT dim, count(*) AS n FROM ev GROUP BY dim), a AS (SELECT t.dim AS target, s.dim AS source, (count(t_eid) + 1.0) / (s.n + 10.0)::DOUBLE AS alpha FROM n t CROSS JOIN n s LEFT JOIN pairs ON t_dim = t.dim AND s_dim = s.dim GROUP BY t.dim, s.dim, s.n), c AS (SELECT target, source, CASE WHEN sum(alpha) OVER (PARTITION BY source) > 0.95 THEN alpha * 0.95 / sum(alpha) OVER (PARTITION BY source) ELSE alpha END AS alpha FROM a) SELECT target, source, round(alpha, 9) AS alpha FROM c WHERE alpha > 0.0001 QUALIFY row_number() OVER (PARTITION BY target ORDER BY alpha DESC, source) <= 2")
def edge_pruning(spark, sf_dir):
    ev = events(spark, sf_dir)
    capped = H.cap_branching(H.initial_alpha(pairs(ev), ev, 10.0, 0.1), 0.95)
    return H.top_edges(capped, 2, 1e-4).select("target", "source", F.round("alpha", 9).alias("alpha"))


def parent_table(spark, sf_dir):
    ev = events(spark, sf_dir)
    edges, mu = parameters(spark, ev)
    return ev, H.parents(ev, H.pair_scores(pairs(ev), edges), mu)


@query("parent_argmax", HEAD + ", " + PARAMS_SQL + ", " + BEST_SQL + " SELECT * FROM par")
def parent_argmax(spark, sf_dir):
    return parent_table(spark, sf_dir)[1].select("eid", "parent")


CASCADE_SQL = ", up(eid, top) AS (SELECT eid, eid FROM par WHERE parent IS NULL UNION ALL SELECT par.eid, up.top FROM par JOIN up ON par.parent = up.eid), cas AS (SELECT eid, min(eid) OVER (PARTITION BY top) AS cascade FROM up)"


@query("cascades", HEAD + ", " + PARAMS_SQL + ", " + BEST_SQL + CASCADE_SQL + " SELECT * FROM cas")
def cascades(spark, sf_dir):
    return H.cascades(parent_table(spark, sf_dir)[1])


@query(
    "group_diagnostics",
    HEAD + ", " + PARAMS_SQL + ", " + BEST_SQL + CASCADE_SQL
    + " , k AS (SELECT cascade, dim, count(*) AS n FROM cas JOIN ev USING (eid) GROUP BY cascade, dim) SELECT cascade, count(*) AS events, count(DISTINCT ne) AS n_ne, count(DISTINCT site) AS n_site, count(DISTINCT dim) AS n_kind, max(ts) - min(ts) AS duration_us, round((SELECT max(n) FROM k WHERE k.cascade = cas.cascade)::DOUBLE / count(*), 9) AS dominant_ratio FROM cas JOIN ev USING (eid) GROUP BY cascade",
)
def group_diagnostics(spark, sf_dir):
    from cascata.operators.metrics import group_profile

    ev, parent_of = parent_table(spark, sf_dir)
    members = H.cascades(parent_of).join(ev, "eid")
    out = group_profile(members, "cascade", "ne", "site", "dim", "ts")
    return out.select("cascade", "events", "n_ne", "n_site", "n_kind", "duration_us", F.round("dominant_ratio", 9).alias("dominant_ratio"))


@query("mhp_fit")
def mhp_fit(spark, sf_dir):
    ev = events(spark, sf_dir)
    model = H.fit(ev, pairs(ev), 2880.0, rounds=30)
    return model["edges"].select("target", "source", "alpha", "beta")
