"""Fault rules: a small typed language, compiled to joins over alarms, site profiles and reachability.

A rule is a graph of roles. The trigger role starts one instance per matching alarm; edges are then walked from there. Each
edge is a join with the reachable sites (direction, hops), a structure filter, and a windowed join with the alarms around the
trigger's time. A primitive role forks an instance per site; a compound role keeps the set of its sites.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascata.operators.graph import reach
from cascata.session import materialize

CRITICAL = ("offline", "power", "link")


@dataclass(frozen=True)
class Node:
    """What a site must be (domains) and what its alarms around the trigger must be."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    required: tuple[str, ...] | None = None
    optional: tuple[str, ...] | None = None
    forbidden: tuple[str, ...] | None = None
    silent: bool = False
    any_alarm: bool = False
    patterns: tuple[Node, ...] = ()
    min_count: int = 1

    @property
    def compound(self) -> bool:
        return bool(self.patterns)

    def fits(self, domains: Column) -> Column:
        """Structure: all domains to include, none to exclude; a compound node fits if one of its patterns does."""
        if self.patterns:
            found = F.lit(False)
            for p in self.patterns:
                found |= p.fits(domains)
            return found
        ok = F.lit(True)
        for d in self.include:
            ok &= F.array_contains(domains, d)
        for d in self.exclude:
            ok &= ~F.array_contains(domains, d)
        return ok


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    direction: str
    before_s: float
    after_s: float
    max_hops: int = 8
    optional: bool = False
    nearest: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    trigger: str
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]
    exclusive: tuple[str, ...] = ()
    constraints: tuple[tuple[tuple[str, ...], tuple[str, ...], int], ...] = field(default=())


def site_profile(elements: DataFrame) -> DataFrame:
    """(site, domains) from element rows (site, domain)."""
    return elements.groupBy("site").agg(F.collect_set("domain").alias("domains"))


def _windowed(cand: DataFrame, alarms: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """Alarms at candidate sites within the window of each instance: inst, site, eid, kind, ts."""
    a = alarms.select(F.col("site").alias("_s"), "eid", "kind", "ts")
    return cand.select("inst", "ref_ts", "site").distinct().join(a, (F.col("site") == F.col("_s")) & F.col("ts").between(F.col("ref_ts") - before_us, F.col("ref_ts") + after_us)).select("inst", "site", "eid", "kind", "ts")


def valid_sites(cand: DataFrame, alarms: DataFrame, node: Node, before_us: int, after_us: int) -> DataFrame:
    """(inst, site) candidates that pass ``node``; cand: inst, ref_ts, site, domains."""
    if node.compound:
        out = None
        for pattern in node.patterns:
            one = valid_sites(cand, alarms, pattern, before_us, after_us)
            out = one if out is None else out.unionByName(one)
        return out.distinct()
    fitting = cand.where(node.fits(F.col("domains")))
    base = fitting.select("inst", "site").distinct()
    if not any((node.required, node.forbidden, node.silent)):
        if node.any_alarm or node.optional is not None:
            return base
        return base.limit(0)
    near = _windowed(fitting, alarms, before_us, after_us)
    banned = CRITICAL if node.silent else (node.forbidden or ())
    flags = near.groupBy("inst", "site").agg(F.count_if(F.col("kind").isin(*banned) if banned else F.lit(False)).alias("_bad"), F.count_if(F.col("kind").isin(*(node.required or ("",)))).alias("_good"))
    if node.required:
        return flags.where((F.col("_good") > 0) & (F.col("_bad") == 0)).select("inst", "site")
    return base.join(flags.where("_bad > 0"), ["inst", "site"], "left_anti")


def collected_alarms(cand: DataFrame, alarms: DataFrame, node: Node, before_us: int, after_us: int) -> DataFrame:
    """(inst, site, eid) alarms that a matched site contributes: required and optional ones, each occurrence once."""
    wanted: set[str] = set()
    for n in node.patterns or (node,):
        wanted |= set(n.required or ()) | set(n.optional or ()) | (set(CRITICAL) if n.any_alarm else set())
    near = _windowed(cand, alarms, before_us, after_us)
    return near.where(F.col("kind").isin(*wanted) if wanted else F.lit(False)).select("inst", "site", "eid").distinct()


def _walk(rule: Rule) -> list[tuple[Edge, str, str]]:
    """Edges in breadth-first order from the trigger, each with the role it starts at and the role it finds."""
    seen, queue, out, used = {rule.trigger}, [rule.trigger], [], set()
    while queue:
        role = queue.pop(0)
        for i, e in enumerate(rule.edges):
            if i in used or role not in (e.source, e.target):
                continue
            other = e.target if role == e.source else e.source
            used.add(i)
            out.append((e, role, other))
            if other not in seen:
                seen.add(other)
                queue.append(other)
    return out


_BACK = {"downstream": "upstream", "upstream": "downstream"}


def match(rule: Rule, alarms: DataFrame, profile: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, symptoms) of a rule.

    alarms: eid, site, kind, ts (microseconds). profile: site, domains. edges: src, dst (downstream). instances: inst, rule,
    trigger_eid, ref_ts and one array of sites per role (null: an optional role that wasn't found). symptoms: inst, role, site, eid.
    """
    trigger = rule.nodes[rule.trigger]
    kinds = sorted({k for n in (trigger.patterns or (trigger,)) for k in (n.required or ())})
    starts = alarms.where(F.col("kind").isin(*kinds)).join(profile.where(trigger.fits(F.col("domains"))), "site", "left_semi")
    state = materialize(starts.select(F.col("eid").cast("string").alias("inst"), F.col("eid").alias("trigger_eid"), F.col("ts").alias("ref_ts"), F.array("site").alias(f"r_{rule.trigger}")), "rule")
    symptoms = state.select("inst", F.lit(rule.trigger).alias("role"), F.col(f"r_{rule.trigger}")[0].alias("site"), F.col("trigger_eid").alias("eid"))
    parts, windows = [symptoms], {}
    for edge, role, other in _walk(rule):
        node = rule.nodes[other]
        direction = edge.direction if role == edge.source else _BACK.get(edge.direction, edge.direction)
        before, after = int(edge.before_s * 1e6), int(edge.after_s * 1e6)
        here = state.select("inst", "ref_ts", F.explode(f"r_{role}").alias("_from"))
        if direction == "self":
            cand = here.withColumn("site", F.col("_from")).withColumn("hop", F.lit(0))
        else:
            r = reach(edges, edge.max_hops, direction, starts=here.select(F.col("_from").alias("node")))  # from the sites in question only
            cand = here.join(r.select(F.col("src").alias("_from"), F.col("dst").alias("site"), "hop"), "_from")
        cand = cand.join(profile, "site").where(node.fits(F.col("domains")))
        if edge.nearest:
            near = Window.partitionBy("inst", "_from")
            cand = cand.withColumn("_m", F.min("hop").over(near)).where("hop = _m").drop("_m")
        cand = materialize(cand, "rule-candidates")
        good = valid_sites(cand, alarms, node, before, after)
        pairs = materialize(cand.select("inst", "_from", "site").distinct().join(good, ["inst", "site"], "left_semi"), "rule-pairs")
        how = "left" if edge.optional else "inner"
        if node.compound:
            found = pairs.groupBy("inst").agg(F.array_sort(F.collect_set("site")).alias(f"r_{other}"), F.array_sort(F.collect_set("_from")).alias("_live")).where(F.size(f"r_{other}") >= node.min_count)
            state = state.join(found, "inst", how)
        else:
            found = pairs.groupBy("inst", "site").agg(F.array_sort(F.collect_set("_from")).alias("_live"))
            state = state.join(found, "inst", how).withColumn("inst", F.concat_ws("|", "inst", "site")).withColumn(f"r_{other}", F.when(F.col("site").isNotNull(), F.array("site"))).drop("site")
        state = state.withColumn(f"r_{role}", F.coalesce("_live", f"r_{role}")).drop("_live")
        state = materialize(state, "rule")
        windows[other] = (node, before, after)
    for other, (node, before, after) in windows.items():
        at = state.where(F.col(f"r_{other}").isNotNull()).select("inst", "ref_ts", F.explode(f"r_{other}").alias("site"))
        parts.append(collected_alarms(at, alarms, node, before, after).select("inst", F.lit(other).alias("role"), "site", "eid"))
    trigger_rows = state.select("inst", F.lit(rule.trigger).alias("role"), F.explode(f"r_{rule.trigger}").alias("site"), F.col("trigger_eid").alias("eid"))
    out = trigger_rows
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out.distinct(), "rule-symptoms")
    for roles, listed, least in rule.constraints:
        carrying = out.where(F.col("role").isin(*roles)).join(alarms.where(F.col("kind").isin(*listed)).select("eid"), "eid", "left_semi")
        enough = carrying.groupBy("inst").agg(F.countDistinct("role").alias("_n")).where(F.col("_n") >= least).select("inst")
        state, out = state.join(enough, "inst", "left_semi"), out.join(enough, "inst", "left_semi")
    return state.withColumn("rule", F.lit(rule.name)), out


def own_exclusively(role_sites: DataFrame, order: list[str]) -> DataFrame:
    """(inst, role, site, hop): a site in several exclusive roles stays with the nearest; ties follow the order of roles."""
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    best = role_sites.groupBy("inst", "site").agg(F.min(F.struct("hop", place.alias("place"), "role")).alias("_b"))
    return best.select("inst", "site", F.col("_b.role").alias("role"), F.col("_b.hop").alias("hop"))


def reduce_dependencies(pairs: list[tuple[str, str, DataFrame]], rounds: int | None = None) -> list[tuple[str, str, DataFrame]]:
    """Semi-join reduction: (role, role, inst-x-y pairs) lists lose sites without a partner in every other list, to a fixpoint."""
    pairs = [(a, b, materialize(df, "reduce")) for a, b, df in pairs]
    before = None
    for _ in range(rounds or 2 * len(pairs) + 2):
        for i, (a, b, df) in enumerate(pairs):
            for j, (c, d, other) in enumerate(pairs):
                if i == j:
                    continue
                for mine, col in ((a, "x"), (b, "y")):
                    for theirs, ocol in ((c, "x"), (d, "y")):
                        if mine == theirs:
                            df = df.join(other.select("inst", F.col(ocol).alias(col)).distinct(), ["inst", col], "left_semi")
            pairs[i] = (a, b, materialize(df.select("inst", "x", "y"), "reduce"))
        sizes = [df.count() for _, _, df in pairs]
        if sizes == before:
            break
        before = sizes
    return pairs


#: Rules of the research set in terms of our alarm kinds; windows in seconds.
OFFLINE_NODE = Node(include=("Transmission",), required=("offline",))
POWER_RULE = Rule("power_rule", "offline_node", {"offline_node": OFFLINE_NODE, "power_node": Node(include=("Transmission",), required=("power",))}, (Edge("power_node", "offline_node", "self", 10_800, 300),))
LINK_RULE = Rule("link_rule", "child", {"child": OFFLINE_NODE, "parent": Node(include=("Transmission",), required=("link",))}, (Edge("parent", "child", "downstream", 3_600, 3_600, max_hops=1),))
STORM_RULE = Rule(
    "transmission_rule",
    "downstream",
    {
        "downstream": Node(patterns=(OFFLINE_NODE,)),
        "parent": Node(include=("Transmission",), optional=("offline",)),
        "grandparent": Node(patterns=(Node(include=("Data",), forbidden=("offline",)), Node(include=("Transmission",), forbidden=("offline",)))),
    },
    (Edge("parent", "downstream", "downstream", 3_600, 3_600, max_hops=1), Edge("parent", "grandparent", "upstream", 3_600, 3_600, nearest=True)),
)
