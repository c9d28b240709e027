"""Lookups among groups and tickets, associations in time, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.operators.intervals import with_next
from cascata.operators.metrics import RELATION_SCORES, f1

#: Time buckets, in the unit of the times (microseconds): of points, and of windows that meet spans of groups.
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Times in free text: date and time of day, with either separator.
TIME_TEXT = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2})?)"


def by_id(records: DataFrame, key: str, wanted: DataFrame, order: Column | None = None) -> DataFrame:
    """Records whose id is among ``wanted`` (one column, named as the key); with ``order`` only the first of each."""
    found = records.join(wanted.select(key).distinct(), key, "left_semi")
    if order is None:
        return found
    rest = [c for c in records.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def groups_with(members: DataFrame, group: str, condition: Column) -> DataFrame:
    """Members of the groups that have at least one member for which ``condition`` holds."""
    return members.join(members.where(condition).select(group).distinct(), group, "left_semi")


def distinct_values(records: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each value of a field occurs; lists count each element."""
    value = F.col(column)
    each = F.explode(value) if dict(records.dtypes)[column].startswith("array") else value
    return records.select(each.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def listed(names: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, n, is_present): how often each name is listed, and whether it is present; null names are left out."""
    there = present.select(F.col(key)).distinct().withColumn("_there", F.lit(True))
    return names.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).join(there, key, "left").select(key, "n", F.coalesce("_there", F.lit(False)).alias("is_present"))


def enriched(symptoms: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """``symptoms`` with the columns of the one metadata row that has the same keys; of several the smallest."""
    rest = [c for c in metadata.columns if c not in keys]
    one = metadata.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_m")).select(*keys, "_m.*")
    return symptoms.join(one, keys, "left")


def cohesion(pairs: DataFrame, group: str, relation: str = "relation") -> DataFrame:
    """(group, pairs, cohesion): the mean score of the relations between a group's elements; relations without a score count 0."""
    score = F.lit(0.0)
    for name, value in RELATION_SCORES.items():
        score = F.when(F.col(relation) == name, value).otherwise(score)
    counts = pairs.groupBy(group, relation).agg(F.count("*").alias("n")).withColumn("_s", score * F.col("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("pairs"), (F.sum("_s") / F.sum("n")).alias("cohesion"))


def in_ticket_windows(alarms: DataFrame, targets: DataFrame, windows: DataFrame) -> DataFrame:
    """(ticket, site): target sites with an alarm inside one of the ticket's windows.

    alarms: site, ts. targets: ticket, site. windows: ticket, start_ts, end_ts, merged, ends included.
    """
    asked = targets.select("ticket", "site").distinct().join(windows.select("ticket", "start_ts", "end_ts"), "ticket")
    return with_next(asked, alarms, ["site"], "start_ts", "ts", HOUR).where("next_ts <= end_ts").select("ticket", "site").distinct()


def upper_bound(targets: DataFrame, direct: DataFrame, inferred: DataFrame) -> DataFrame:
    """Per ticket: target sites, those with direct and with inferred evidence, recall, and precision and F1 (1 by construction where anything is found)."""
    found = direct.select("ticket", "site", F.lit(True).alias("d"), F.lit(False).alias("i")).union(inferred.select("ticket", "site", F.lit(False), F.lit(True)))
    found = found.groupBy("ticket", "site").agg(F.max("d").alias("d"), F.max("i").alias("i"))
    each = targets.select("ticket", "site").distinct().join(found, ["ticket", "site"], "left").groupBy("ticket")
    n = each.agg(F.count("*").alias("sites"), F.count_if("d").alias("direct"), F.count_if("i").alias("inferred"), F.count_if(F.col("d") | F.col("i")).alias("associated"))
    recall, precision = F.col("associated") / F.col("sites"), F.when(F.col("associated") > 0, 1.0).otherwise(0.0)
    return n.select("ticket", "sites", "direct", "inferred", "associated", recall.alias("recall"), precision.alias("precision"), f1(precision, recall).alias("f1"))


def fully_associable(recalls: DataFrame, bounds: DataFrame) -> DataFrame:
    """Recall rows of the tickets whose sites the upper bound covers in full."""
    return recalls.join(bounds.where("sites > 0 and associated = sites").select("ticket"), "ticket", "left_semi")


def combined_recall(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(ticket, recall of either side): both recalls of every ticket that one of them has."""
    a, b = (df.select("ticket", F.col("recall").alias(f"{n}_recall")) for df, n in zip((left, right), names))
    return a.join(b, "ticket", "full")


def both_directions(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(direction, group, best, n_target, n_hit, recall, precision, f1): each group's best match on the other side, by sites.

    gold, predicted: group, site. The best match shares most sites, then has fewest, then the smallest name. Groups are
    joined through their sites only.
    """

    def one_way(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        a = mine.select("group", "site").distinct()
        b = other.select(F.col("group").alias("other"), "site").distinct()
        sizes = a.groupBy("group").agg(F.count("*").alias("n_target")), b.groupBy("other").agg(F.count("*").alias("n_other"))
        shared = a.join(b, "site").groupBy("group", "other").agg(F.count("*").alias("n_hit")).join(sizes[1], "other")
        best = shared.groupBy("group").agg(F.min(F.struct((-F.col("n_hit")).alias("h"), "n_other", "other")).alias("m"))
        hit = F.coalesce(-F.col("m.h"), F.lit(0))
        recall, precision = hit / F.col("n_target"), F.coalesce(hit / F.col("m.n_other"), F.lit(0.0))
        return sizes[0].join(best, "group", "left").select(F.lit(name).alias("direction"), "group", F.col("m.other").alias("best"), "n_target", hit.alias("n_hit"), recall.alias("recall"), precision.alias("precision"), f1(precision, recall).alias("f1"))

    return one_way(gold, predicted, "gold_to_predicted").unionByName(one_way(predicted, gold, "predicted_to_gold"))


def groups_by_evidence(evidence: DataFrame, members: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(ticket, group_id): groups that hold one of the ticket's alarms. evidence: ticket, eid. members: group_id, eid."""
    found = evidence.select("ticket", "eid").distinct().join(members.select("group_id", "eid").distinct(), "eid").select("ticket", "group_id").distinct()
    return found if excluded is None else found.join(excluded.select("ticket", "group_id"), ["ticket", "group_id"], "left_anti")


def groups_by_windows(windows: DataFrame, candidates: DataFrame, members: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(ticket, group_id): groups with an alarm on a candidate site (ticket, site) inside one of the ticket's windows.

    A window meets the spans of a site's groups, not their alarms. Where the first or last alarm of a span lies in the window,
    that is all; only for a window inside a span the next alarm after its start is looked up.
    """
    asked = candidates.select("ticket", "site").distinct().join(windows.select("ticket", "start_ts", "end_ts"), "ticket").where("start_ts <= end_ts")
    spans = members.groupBy("site", "group_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where("first is not null")
    days = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / DAY), F.floor(F.col(b) / DAY))))
    met = days(asked, "start_ts", "end_ts").join(days(spans, "first", "last"), ["site", "_b"])
    met = met.where((F.col("first") <= F.col("end_ts")) & (F.col("last") >= F.col("start_ts")) & (F.floor(F.greatest("first", "start_ts") / DAY) == F.col("_b")))  # each pair once
    inside = (F.col("first") >= F.col("start_ts")) | (F.col("last") <= F.col("end_ts"))
    deeper = with_next(met.where(~inside).select("ticket", "site", "group_id", "start_ts", "end_ts"), members, ["site", "group_id"], "start_ts", "ts", DAY).where("next_ts <= end_ts")
    found = met.where(inside).select("ticket", "group_id").union(deeper.select("ticket", "group_id")).distinct()
    return found if excluded is None else found.join(excluded.select("ticket", "group_id"), ["ticket", "group_id"], "left_anti")


def vocabulary(events: DataFrame, label: str, *order: str) -> DataFrame:
    """(label, first, n): labels with the place of their first event and their count; the rank of ``first`` is the id by appearance."""
    return events.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))


def with_topology_prior(numerators: DataFrame, prior: DataFrame, strength: float, boost: float) -> DataFrame:
    """``numerators`` (src, dst, num) with strength * boost * score of the pair's relation added; pairs without one stay."""
    joined = numerators.join(prior.select("src", "dst", "score"), ["src", "dst"], "left")
    return joined.select("src", "dst", (F.col("num") + strength * boost * F.coalesce("score", F.lit(0.0))).alias("num"))


def incident_times(cells: DataFrame, date: Column | None = None) -> DataFrame:
    """(ticket, column, cell_text, times): times named in free text cells (ticket, column, cell_text), in order and once each.

    Cells that are nothing but one time are no text. With ``date`` (yyyyMMdd), times of that day only, where it is known.
    """
    text = F.trim("cell_text")
    times = F.array_distinct(F.regexp_extract_all(text, F.lit(TIME_TEXT), 1))
    if date is not None:
        same = lambda t: F.date_format(F.to_date(F.regexp_replace(F.substring_index(F.replace(t, F.lit("T"), F.lit(" ")), " ", 1), "/", "-"), "yyyy-M-d"), "yyyyMMdd") == date
        times = F.when(date.isNull(), times).otherwise(F.filter(times, same))
    rows = cells.where(F.col("cell_text").isNotNull() & ~text.rlike(f"^{TIME_TEXT}$")).select("ticket", "column", text.alias("cell_text"), times.alias("times"))
    return rows.where(F.size("times") > 0).distinct()


def flips(base: DataFrame, variant: DataFrame) -> DataFrame:
    """(category, n, bridge_flips): why pairs that were two-way in ``base`` are directed in ``variant``; 'removed' pairs are gone.

    base: a, b, relation, is_bridge, strict_ring. variant also: constrained, ring_entry, method.
    """
    v = variant.select("a", "b", F.col("relation").alias("_rel"), F.col("is_bridge").alias("_bridge"), F.col("strict_ring").alias("_ring"), "constrained", "ring_entry", "method", F.lit(True).alias("_there"))
    both = base.join(v, ["a", "b"], "left")
    turned = F.col("_there").isNull() | ((F.col("relation") == "<->") & (F.col("_rel") == "->"))
    category = (
        F.when(F.col("_there").isNull(), "removed").when(F.col("constrained"), "constraint_forced")
        .when(F.col("strict_ring") & ~(F.col("_ring") | F.col("ring_entry")), "ring_force_lost")
        .when(F.col("method") == "global_level_gap", "gap_first_directed").otherwise("voting_directed")
    )
    return both.where(turned).groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("_there") & ~F.col("is_bridge") & F.col("_bridge")).alias("bridge_flips"))


def visible_roles(roles: DataFrame, alarms: DataFrame) -> DataFrame:
    """Role sites (group_id, role, site, hide_if_no_alarms) without those that hide when no alarm of the group lies on them."""
    with_alarm = alarms.select("group_id", "site").distinct().withColumn("_has", F.lit(True))
    return roles.join(with_alarm, ["group_id", "site"], "left").where(~F.col("hide_if_no_alarms") | F.col("_has")).drop("_has")
