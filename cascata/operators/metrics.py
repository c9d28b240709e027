"""Group, recall and health metrics; set and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascata.operators.ranking import running_totals

#: How well a topology relation explains a pair, and the weights of the health components.
RELATION_SCORES = {"same_device": 1.0, "direct": 0.9, "same_site": 0.75, "indirect": 0.5, "cross_site": 0.2, "unknown": 0.05}
HEALTH_WEIGHTS = {"topology": 0.30, "time": 0.20, "size": 0.15, "singleton": 0.15, "virtual": 0.10, "risk": 0.10}
CLEAR_WEIGHTS = {"separation": 0.40, "compactness": 0.30, "coverage": 0.15, "bulk": 0.15}


def group_profile(members: DataFrame, group: str, ne: str, site: str, kind: str, ts: str) -> DataFrame:
    """Per group: events, distinct elements, sites and kinds, duration, share of the most frequent kind."""
    kinds = members.groupBy(group, kind).agg(F.count("*").alias("_k")).groupBy(group).agg(F.max("_k").alias("_top"), F.count("*").alias("n_kind"))
    base = members.groupBy(group).agg(F.count("*").alias("events"), F.countDistinct(ne).alias("n_ne"), F.countDistinct(site).alias("n_site"), (F.max(ts) - F.min(ts)).alias("duration_us"))
    return base.join(kinds, group).withColumn("dominant_ratio", F.col("_top") / F.col("events")).drop("_top")


def floor_percentiles(df: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """(by..., p, value) at index int(p / 100 * (n - 1)) of the sorted values: no interpolation.

    Ranks come from running counts over distinct values, so repeated values cost one row each.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    if by:
        w = Window.partitionBy(*by).orderBy("v")
        upto = counts.withColumn("hi", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    else:
        upto = running_totals(counts, [F.col("v")], {"hi": F.col("n")}, "percentiles")
        upto = upto.crossJoin(F.broadcast(upto.agg(F.max("hi").alias("total"))))  # one row
    wanted = upto.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("at", F.floor(F.col("p") * (F.col("total") - 1) / 100))
    return wanted.where((F.col("at") < F.col("hi")) & (F.col("at") >= F.col("hi") - F.col("n"))).select(*by, "p", F.col("v").alias("value"))


def histogram(df: DataFrame, value: Column, uppers: list[float], by: list[str] | None = None) -> DataFrame:
    """Counts per bucket; an upper edge belongs to its bucket, what exceeds the last one is '>max'."""
    bucket = F.lit(f">{uppers[-1]:g}")
    for u in reversed(uppers):
        bucket = F.when(value <= u, f"<={u:g}").otherwise(bucket)
    return df.groupBy(*(by or []), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def midrank_auc(df: DataFrame, value: str, positive: str) -> DataFrame:
    """P(positive < other) + ties / 2, in one row; ranks are summed over distinct values, so nothing is sorted twice."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    counts = running_totals(counts, [F.col("v")], {"upto": F.col("p")}, "auc")
    below = F.col("upto") - F.col("p")
    wins = counts.withColumn("w", F.col("q") * (below + F.col("p") / F.lit(2.0)))
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("n_within"), F.sum("q").alias("n_null"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def site_metrics(target: DataFrame, predicted: DataFrame, key: str, site: str) -> DataFrame:
    """Per key: sizes, recall, precision and F1 of two sets of sites; an empty side gives 0."""
    both = target.select(key, site).distinct().withColumn("t", F.lit(1)).join(predicted.select(key, site).distinct().withColumn("p", F.lit(1)), [key, site], "full")
    n = both.groupBy(key).agg(F.count("t").alias("n_target"), F.count("p").alias("n_predicted"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("n_hit"))
    recall = F.when(F.col("n_target") > 0, F.col("n_hit") / F.col("n_target")).otherwise(0.0)
    precision = F.when(F.col("n_predicted") > 0, F.col("n_hit") / F.col("n_predicted")).otherwise(0.0)
    return n.select(key, "n_target", "n_predicted", "n_hit", recall.alias("recall"), precision.alias("precision"), f1(precision, recall).alias("f1"))


def best_group(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(ticket, group_id, covered, alarmed): the group that covers most target sites; then most with alarms; then smallest id.

    groups: group_id, site, has_alarm. targets: ticket, site.
    """
    hit = targets.select("ticket", "site").distinct().join(groups.groupBy("group_id", "site").agg(F.max("has_alarm").alias("has_alarm")), "site")
    score = hit.groupBy("ticket", "group_id").agg(F.count("*").alias("covered"), F.count_if("has_alarm").alias("alarmed"))
    order = Window.partitionBy("ticket").orderBy(F.desc("covered"), F.desc("alarmed"), "group_id")
    return score.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def expand_by_time(base: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(ticket, group_id): base groups, and those that windows of +-width around known times reach, again and again.

    base: ticket, group_id. candidates: ticket, group_id, ts (whole seconds). A chain of times at most ``width`` apart is one
    island, and a group joins the islands of its times; so the fixpoint is reachability between groups and islands.
    """
    from cascata.operators.components import connected_components

    w = Window.partitionBy("ticket").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    times = candidates.select("ticket", "group_id", "ts").distinct().withColumn("_new", F.when(gap.isNull() | (gap > width), 1).otherwise(0))
    times = times.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    g = F.concat_ws("|", F.lit("g"), "ticket", "group_id")
    edges = times.select(g.alias("src"), F.concat_ws("|", F.lit("i"), "ticket", "_island").alias("dst")).distinct()
    comp = connected_components(edges)
    named = candidates.select("ticket", "group_id").union(base.select("ticket", "group_id")).distinct().withColumn("node", g).join(comp, "node", "left").select("ticket", "group_id", F.coalesce("component", "node").alias("c"))
    seeds = named.join(base.select("ticket", "group_id").distinct(), ["ticket", "group_id"], "left_semi").select("ticket", "c").distinct()
    return named.join(seeds, ["ticket", "c"], "left_semi").select("ticket", "group_id")


def confusion_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """accuracy, macro F1 and Cohen's kappa of labelled rows, in one row. Only the small confusion table is gathered."""
    table = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = table.select("g", F.col("g").alias("label"), "p", "n")
    by_gold = rows.groupBy("g").agg(F.sum("n").alias("gold"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = rows.groupBy("p").agg(F.sum("n").alias("pred"))
    each = by_gold.join(by_pred, F.col("g") == F.col("p"), "full").select(F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("hit", F.lit(0)).alias("hit"))
    fscore = F.when(F.col("gold") + F.col("pred") > 0, 2 * F.col("hit") / (F.col("gold") + F.col("pred"))).otherwise(0.0)
    s = each.agg(F.sum("gold").alias("n"), F.sum("hit").alias("hit"), F.avg(fscore).alias("macro_f1"), F.sum(F.col("gold") * F.col("pred")).cast("double").alias("chance"))
    observed, chance = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return s.select(observed.alias("accuracy"), "macro_f1", F.when(chance < 1, (observed - chance) / (1 - chance)).otherwise(1.0).alias("kappa"))


def compare_directions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, left_direction, right_direction, change) of two sets of site pairs (a < b, direction)."""
    j = left.select("a", "b", F.col("direction").alias("l")).join(right.select("a", "b", F.col("direction").alias("r")), ["a", "b"], "full")
    change = (
        F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("l") == F.col("r"), "agree")
        .when((F.col("l") != "<->") & (F.col("r") != "<->"), "reversed").when(F.col("l") == "<->", "bidirectional_to_directed").otherwise("directed_to_bidirectional")
    )
    return j.select("a", "b", F.col("l").alias("left_direction"), F.col("r").alias("right_direction"), change.alias("change"))


def compare_hops(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes, intersection, Jaccard of (src, dst) pairs, and how many common pairs differ in hop."""
    j = left.select("src", "dst", F.col("hop").alias("l")).join(right.select("src", "dst", F.col("hop").alias("r")), ["src", "dst"], "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    s = j.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(both).alias("n_common"), F.count("*").alias("n_union"), F.count_if(both & (F.col("l") != F.col("r"))).alias("hop_differs"))
    return s.withColumn("jaccard", F.when(F.col("n_union") > 0, F.col("n_common") / F.col("n_union")).otherwise(1.0))


def health(profile: DataFrame, cohesion: Column, virtual_ratio: Column, risk_ratio: Column, target_s: float = 3600.0, target_virtual: float = 0.2, p50: float = 2.0, p90: float = 20.0, p99: float = 100.0) -> DataFrame:
    """One row with six components and their weighted score. profile: events, duration_s, per group; percentiles by floor index."""
    sizes = floor_percentiles(profile, "events", [50, 90, 99]).groupBy().pivot("p", [50, 90, 99]).agg(F.first("value"))
    spans = floor_percentiles(profile, "duration_s", [90]).select(F.col("value").alias("span"))
    one = profile.agg(F.avg((F.col("events") <= 1).cast("double")).alias("singleton"), F.count("*").alias("groups")).crossJoin(sizes).crossJoin(spans)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    size = 0.35 * F.least(F.col("50") / p50, F.lit(1.0)) + 0.40 * F.exp(-F.greatest(F.lit(0.0), F.col("90") - p90) / p90) + 0.25 * F.exp(-F.greatest(F.lit(0.0), F.col("99") - p99) / p99)
    parts = {
        "topology": clip(100 * cohesion), "time": 100 * F.exp(-F.greatest(F.col("span"), F.lit(0.0)) / target_s), "size": clip(100 * size),
        "singleton": clip(100 * (1 - F.col("singleton"))), "virtual": 100 * F.exp(-virtual_ratio / target_virtual), "risk": clip(100 * (1 - risk_ratio)),
    }
    total = sum((HEALTH_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    return one.select("groups", *[v.alias(k) for k, v in parts.items()], clip(total).alias("health"))


def rank_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC (ties count half), average precision (ties in one step) and log-loss, in one row."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    counts = running_totals(counts, [F.desc("s")], {"tp": F.col("p"), "n": F.col("p") + F.col("q")}, "ranks")
    tp, n, above = F.col("tp"), F.col("n"), F.col("tp") - F.col("p")
    each = counts.select("p", "q", (F.col("p") * tp / n).alias("ap"), (F.col("q") * (above + F.col("p") / 2)).alias("auc"))
    one = each.agg((F.sum("auc") / (F.sum("p") * F.sum("q"))).alias("roc_auc"), (F.sum("ap") / F.sum("p")).alias("average_precision"))
    s = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(score)))
    loss = df.agg(F.avg(F.when(F.col(label) == 1, -F.log(s)).otherwise(-F.log(1 - s))).alias("log_loss"))
    return one.crossJoin(loss)


def threshold_grid(df: DataFrame, label: str, score: str, thresholds: list[float], beta: float = 1.0) -> DataFrame:
    """(threshold, precision, recall, f) for each threshold; the best comes first by f, then the smaller threshold."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.col(score) >= F.col("threshold")
    c = rows.groupBy("threshold").agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit).alias("pp"), F.count_if(F.col(label) == 1).alias("p"))
    precision = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    recall = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    f = F.when(F.col("tp") > 0, (1 + beta**2) * precision * recall / (beta**2 * precision + recall)).otherwise(0.0)
    return c.select("threshold", precision.alias("precision"), recall.alias("recall"), f.alias("f"))


def clear_health(parts: dict[str, Column]) -> Column:
    """Weighted mean of the components that are not null: weights of missing ones are shared out."""
    weight = sum((F.when(c.isNotNull(), CLEAR_WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    total = sum((CLEAR_WEIGHTS[k] * F.coalesce(c, F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)
