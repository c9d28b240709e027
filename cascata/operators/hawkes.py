"""Statistical parent attribution: exponential Hawkes scores over history pairs, EM steps, decoding, cascades.

Event types form a small vocabulary (``dims``); parameters are small tables: mu(dim, mu) and edge(target, source, alpha, beta).
Pairs come from :func:`cascata.operators.intervals.history_pairs` and are written once per fit; every EM round is two
aggregations over them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascata.operators.components import connected_components
from cascata.operators.graph import spectral_radius
from cascata.operators.ranking import running_totals
from cascata.session import materialize

EPS = 1e-12


def pair_scores(pairs: DataFrame, edges: DataFrame, late: Column | None = None) -> DataFrame:
    """Adds score = alpha * beta * exp(-beta * max(dt, 0)) [* late weight]; pairs: t_dim, s_dim, dt in kernel time units."""
    side = edges.select(F.col("target").alias("t_dim"), F.col("source").alias("s_dim"), "alpha", "beta")
    joined = pairs.join(side, ["t_dim", "s_dim"])  # broadcast if its measured size allows
    score = F.col("alpha") * F.col("beta") * F.exp(-F.col("beta") * F.greatest(F.col("dt"), F.lit(0.0)))
    return joined.withColumn("score", score if late is None else score * late)


def estep(events: DataFrame, scored: DataFrame, mu: DataFrame) -> DataFrame:
    """Per pair p = score / rate; rate = max(mu + sum of scores, eps). events: eid, dim. Adds p_parent to the pairs."""
    total = scored.groupBy("t_eid").agg(F.sum("score").alias("total"))
    rate = events.join(mu, "dim").join(total, F.col("eid") == F.col("t_eid"), "left")
    rate = rate.select("eid", "dim", "mu", F.greatest(F.col("mu") + F.coalesce("total", F.lit(0.0)), F.lit(EPS)).alias("rate"))
    return rate


def estep_sums(events: DataFrame, scored: DataFrame, mu: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by pair of dims: sum p, sum p * dt), (by dim: sum of p_self, sum of log rate, n)."""
    rate = materialize(estep(events, scored, mu), "em-rate")
    p = scored.join(rate.select(F.col("eid").alias("t_eid"), "rate"), "t_eid").withColumn("p", F.col("score") / F.col("rate"))
    by_pair = p.groupBy("t_dim", "s_dim").agg(F.sum("p").alias("sum_p"), F.sum(F.col("p") * F.col("dt")).alias("sum_p_dt"))
    by_dim = rate.groupBy("dim").agg(F.sum(F.col("mu") / F.col("rate")).alias("sum_self"), F.sum(F.log("rate")).alias("sum_log_rate"), F.count("*").alias("n"))
    return by_pair, by_dim


def initial_mu(events: DataFrame, horizon: float) -> DataFrame:
    return events.groupBy("dim").agg(F.greatest(F.lit(0.05 / horizon), 0.1 * F.log1p(F.count("*").cast("double")) / horizon).alias("mu"))


def initial_alpha(pairs: DataFrame, events: DataFrame, prior_weight: float, prior_mean: float, factor: float = 1.0) -> DataFrame:
    """alpha = (n_pair + K m) / (n_source f + K) for every pair of dims, seen or not: the prior covers all of dims x dims."""
    counts = events.groupBy("dim").agg(F.count("*").alias("n"))
    grid = counts.select(F.col("dim").alias("target")).crossJoin(counts.select(F.col("dim").alias("source"), "n"))  # vocabulary squared
    seen = pairs.groupBy(F.col("t_dim").alias("target"), F.col("s_dim").alias("source")).agg(F.count("*").alias("pairs"), F.sum("dt").alias("sum_dt"))
    return grid.join(seen, ["target", "source"], "left").select("target", "source", ((F.coalesce("pairs", F.lit(0)) + prior_weight * prior_mean) / (F.col("n") * factor + prior_weight)).alias("alpha"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("sum_dt", F.lit(0.0)).alias("sum_dt"))


def sparse_alpha(seen: DataFrame, counts: DataFrame, prior_weight: float, prior_mean: float, cap: float, k: int, threshold: float, factor: float = 1.0) -> DataFrame:
    """(target, source, alpha): the same as initial values for all of dims x dims, capped and cut to the top ``k`` of each target.

    seen: target, source, num (pairs or expected pairs) of the pairs that occur. Pairs that don't occur share the value that
    their source's prior gives, so they enter a source's branching sum by their number, and a target's top by the order of
    the sources' values: work grows with the pairs that occur and k times the vocabulary, not with its square.
    """
    prior = prior_weight * prior_mean
    size = counts.count()
    alpha = seen.join(counts.select(F.col("dim").alias("source"), "n"), "source").select("target", "source", ((F.col("num") + prior) / (F.col("n") * factor + prior_weight)).alias("alpha"))
    alpha = materialize(alpha, "em-seen")
    sums = alpha.groupBy("source").agg(F.sum("alpha").alias("_sum"), F.count("*").alias("_seen"))
    unseen = F.lit(prior) / (F.col("n") * factor + prior_weight)
    sources = counts.select(F.col("dim").alias("source"), unseen.alias("alpha")).join(sums, "source", "left")
    total = F.coalesce("_sum", F.lit(0.0)) + (size - F.coalesce("_seen", F.lit(0))) * F.col("alpha")
    sources = sources.select("source", "alpha", F.when(total > cap, cap / total).otherwise(1.0).alias("scale"))
    ranked = running_totals(sources.select("source", "scale", (F.col("alpha") * F.col("scale")).alias("alpha")), [F.desc("alpha"), F.col("source")], {"place": F.lit(1)}, "em-sources")
    scaled = alpha.join(ranked.select("source", "scale"), "source").select("target", "source", (F.col("alpha") * F.col("scale")).alias("alpha"))
    wide = counts.select(F.col("dim").alias("target")).join(alpha.groupBy("target").agg(F.count("*").alias("_s")), "target", "left")
    # Of the sources that a target hasn't seen, k are among the first k + (number it has seen).
    first = wide.select("target", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), k + F.coalesce("_s", F.lit(0))).cast("int"))).alias("place"))
    others = first.join(ranked.where(F.col("alpha") > threshold).select(F.col("place").cast("int").alias("place"), "source", "alpha"), "place").select("target", "source", "alpha")
    others = others.join(scaled.select("target", "source"), ["target", "source"], "left_anti")
    return top_edges(scaled.unionByName(others), k, threshold)


def cap_branching(edges: DataFrame, cap: float) -> DataFrame:
    """Scales the alphas of a source whose sum over targets exceeds the cap."""
    total = F.sum("alpha").over(Window.partitionBy("source"))
    return edges.withColumn("alpha", F.when(total > cap, F.col("alpha") * cap / total).otherwise(F.col("alpha")))


def top_edges(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` largest alphas of each target, then those above the threshold; ties go to the smaller source."""
    order = Window.partitionBy("target").orderBy(F.desc("alpha"), "source")
    return edges.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= k) & (F.col("alpha") > threshold)).drop("_r")


def parents(events: DataFrame, scored: DataFrame, mu: DataFrame) -> DataFrame:
    """(eid, parent, score, mu): the best scored source; null where mu exceeds it. Ties: the earliest source by sequence."""
    best = scored.groupBy("t_eid").agg(F.max(F.struct("score", (-F.col("s_seq")).alias("o"), "s_eid")).alias("b"))
    joined = events.join(mu, "dim").join(best, F.col("eid") == F.col("t_eid"), "left")
    wins = F.col("b.score").isNotNull() & ~(F.col("mu") > F.col("b.score"))
    return joined.select("eid", F.when(wins, F.col("b.s_eid")).alias("parent"), F.coalesce("b.score", F.lit(0.0)).alias("score"), "mu")


def cascades(parent_of: DataFrame) -> DataFrame:
    """(eid, cascade): the smallest event of each tree of parent pointers."""
    linked = parent_of.where("parent is not null")
    comp = connected_components(linked, "eid", "parent")
    return parent_of.select("eid").join(comp, F.col("eid") == F.col("node"), "left").select("eid", F.coalesce("component", "eid").alias("cascade"))


def log_likelihood(by_dim: DataFrame, mu: DataFrame, edges: DataFrame, horizon: float) -> float:
    """sum log rate - T sum mu - sum alpha (the form without time slack)."""
    rates = by_dim.agg(F.sum("sum_log_rate")).first()[0] or 0.0
    return rates - horizon * (mu.agg(F.sum("mu")).first()[0] or 0.0) - (edges.agg(F.sum("alpha")).first()[0] or 0.0)


def fit(events: DataFrame, pairs: DataFrame, horizon: float, rounds: int = 5, beta: float = 1.0, prior: float = 10.0, prior_mean: float = 0.1, cap: float = 0.95, k: int = 32, threshold: float = 1e-4, tolerance: float = 1e-4, on_round=None) -> dict:
    """MAP-EM: {'mu', 'edges', 'log_likelihood', 'trace'}. ``on_round(i, ll)`` may return True to stop.

    The best parameters by log-likelihood are those before the round's M-step; alphas are finally scaled to a spectral radius
    of at most 0.95.
    """
    pairs = materialize(pairs, "em-pairs")
    events = materialize(events, "em-events")
    counts = materialize(events.groupBy("dim").agg(F.count("*").alias("n")), "em-counts")
    mu = materialize(initial_mu(events, horizon), "em-mu")
    seen = pairs.groupBy(F.col("t_dim").alias("target"), F.col("s_dim").alias("source")).agg(F.count("*").alias("num"))
    edges = materialize(sparse_alpha(seen, counts, prior, prior_mean, cap, k, threshold).withColumn("beta", F.lit(beta)), "em-edges")
    best, trace = None, []
    for i in range(rounds):
        by_pair, by_dim = estep_sums(events, pair_scores(pairs, edges), mu)
        by_pair, by_dim = materialize(by_pair, "em-pair"), materialize(by_dim, "em-dim")
        ll = log_likelihood(by_dim, mu, edges, horizon)
        if best is None or ll > best[0]:
            best = (ll, mu, edges)
        if trace and abs(ll - trace[-1]) <= tolerance * max(1.0, abs(trace[-1])):
            trace.append(ll)
            break
        trace.append(ll)
        if on_round and on_round(i, ll):
            break
        mu = materialize(by_dim.select("dim", F.greatest(F.col("sum_self") / horizon, F.lit(0.05 / horizon)).alias("mu")), "em-mu")
        seen = by_pair.select(F.col("t_dim").alias("target"), F.col("s_dim").alias("source"), F.col("sum_p").alias("num"))
        edges = materialize(sparse_alpha(seen, counts, prior, prior_mean, cap, k, threshold).withColumn("beta", F.lit(beta)), "em-edges")
    ll, mu, edges = best
    radius = spectral_radius(edges)
    if radius > 0.95:
        edges = edges.withColumn("alpha", F.col("alpha") * (0.95 / radius))
    return {"mu": mu, "edges": edges, "log_likelihood": ll, "trace": trace, "spectral_radius": radius}


def clear_teacher(pairs: DataFrame, boost: float, tau: float) -> DataFrame:
    """Redistributes p over a target's candidates towards those that clear at a similar time; p_self and the total stay.

    pairs: t_eid, p, t_clear, s_clear (null: unknown).
    """
    weight = F.when(F.col("t_clear").isNull() | F.col("s_clear").isNull(), 1.0).otherwise(1 + boost * F.exp(-F.abs(F.col("t_clear") - F.col("s_clear")) / tau))
    w = Window.partitionBy("t_eid")
    raised = F.col("p") * weight
    return pairs.withColumn("p", F.when(F.sum(raised).over(w) > 0, raised * F.sum("p").over(w) / F.sum(raised).over(w)).otherwise(0.0))


def simulate(mu: list[float], alpha: list[list[float]], beta: float, horizon: float, seed: int, most: int = 100_000) -> list[tuple[int, float, int, int]]:
    """Cluster generator for fixtures: (event, time, dim, parent or -1), by time."""
    rng = np.random.default_rng(seed)
    events = [(float(t), d, -1) for d, m in enumerate(mu) for t in np.sort(rng.uniform(0, horizon, rng.poisson(m * horizon)))]
    at = 0
    while at < len(events) and len(events) < most:
        t, d, _ = events[at]
        for target in range(len(mu)):
            for wait in rng.exponential(1 / beta, rng.poisson(alpha[target][d])):
                if t + wait < horizon:
                    events.append((t + float(wait), target, at))
        at += 1
    order = sorted(range(len(events)), key=lambda i: events[i][0])
    place = {old: new for new, old in enumerate(order)}
    return [(place[i], events[i][0], events[i][1], place[events[i][2]] if events[i][2] >= 0 else -1) for i in order]


def wilson_lower(hits: int, n: int, z: float = 1.96) -> float:
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
