"""Fault groups: merging by shared alarms, component merge, history, completion and filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascata.operators.components import connected_components


def merge_by_alarm(members: DataFrame) -> DataFrame:
    """(group_id, merged_id) for groups (group_id, alarm_key) that share alarms, transitively; bipartite, so linear in members."""
    node = F.concat(F.lit("g:"), F.col("group_id").cast("string"))
    edges = members.select(node.alias("src"), F.concat(F.lit("z:"), F.col("alarm_key").cast("string")).alias("dst"))
    comp = connected_components(edges).where(F.col("node").startswith("g:"))
    return comp.select(F.expr("substring(node, 3)").alias("group_id"), F.expr("substring(component, 3)").alias("merged_id"))


def merge_components(groups: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per merged group: its rules joined with ' + ' in name order, its sites, alarms and former groups.

    groups: group_id, rule, site, alarm_key rows.
    """
    joined = groups.join(merged, "group_id")
    rules = F.array_join(F.array_sort(F.collect_set("rule")), " + ")
    return joined.groupBy("merged_id").agg(rules.alias("rule"), F.countDistinct("site").alias("sites"), F.countDistinct("alarm_key").alias("alarms"), F.countDistinct("group_id").alias("merged_groups"))


def bipartite_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shared) of two groupings of alarms (group_id, alarm_key)."""
    j = left.select(F.col("group_id").alias("left_id"), "alarm_key").distinct().join(right.select(F.col("group_id").alias("right_id"), "alarm_key").distinct(), "alarm_key")
    return j.groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


class GroupHistory:
    """Emitted groups of one component: a repeat is suppressed, a superset absorbs, sharing groups merge."""

    def __init__(self, stay: float):
        self.stay, self.groups = stay, []

    def offer(self, group_id: str, alarms: frozenset, now: float) -> tuple[str, frozenset, list[str]]:
        """('suppressed' or 'emitted', alarms as emitted, ids of the groups that it absorbed)."""
        self.groups = [g for g in self.groups if now - g[2] <= self.stay]
        for g in self.groups:
            if alarms <= g[1]:
                g[2] = max(g[2], now)
                return "suppressed", alarms, []
        related = [g for g in self.groups if g[1] & alarms]
        merged = alarms.union(*[g[1] for g in related]) if related else alarms
        self.groups = [g for g in self.groups if g not in related]
        self.groups.append([group_id, merged, now])
        return "emitted", merged, [g[0] for g in related]


def replay_history(matches: DataFrame, stay_s: float) -> DataFrame:
    """(group_id, action, n_alarms, absorbed) of matches (group_id, ts, alarm_key) taken in order of ts and id.

    Only matches that share alarms affect one another, so each connected component replays on its own.
    """
    merged = merge_by_alarm(matches).withColumnRenamed("merged_id", "component")
    rows = matches.withColumn("group_id", F.col("group_id").cast("string")).join(merged, "group_id")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        history, out = GroupHistory(stay_s), []
        for (ts, group), part in pdf.groupby(["ts", "group_id"], sort=True):
            action, alarms, absorbed = history.offer(group, frozenset(part["alarm_key"]), float(ts))
            out.append((group, action, len(alarms), ",".join(sorted(absorbed))))
        return pd.DataFrame(out, columns=["group_id", "action", "n_alarms", "absorbed"])

    return rows.select("component", "group_id", F.col("ts").cast("double").alias("ts"), F.col("alarm_key").cast("string").alias("alarm_key")).groupBy("component").applyInPandas(replay, "group_id string, action string, n_alarms long, absorbed string")


def complete_topology(group_sites: DataFrame, elements: DataFrame) -> DataFrame:
    """(group_id, site, ne, topology_added): every element at the sites of a group; those without an alarm were added.

    group_sites: group_id, site, ne (with alarms). elements: ne, site.
    """
    sites = group_sites.select("group_id", "site").distinct().join(elements.select("ne", "site").distinct(), "site")
    own = group_sites.select("group_id", "ne").distinct().withColumn("_own", F.lit(True))
    return sites.join(own, ["group_id", "ne"], "left").select("group_id", "site", "ne", F.col("_own").isNull().alias("topology_added"))


def by_site_count(groups: DataFrame, most: int, keep_large: bool = False) -> DataFrame:
    n = groups.groupBy("group_id").agg(F.countDistinct("site").alias("sites"))
    return n.where(F.col("sites") > most) if keep_large else n.where(F.col("sites") <= most)


def with_rules(groups: DataFrame, wanted: list[str], mode: str = "any") -> DataFrame:
    """Groups (group_id, rules array) that have any of the wanted rules, or all of them."""
    chosen = F.array(*[F.lit(r) for r in wanted])
    return groups.where(F.arrays_overlap("rules", chosen) if mode == "any" else F.size(F.array_except(chosen, "rules")) == 0)
