"""Graph operators as loops of DataFrame joins over edge tables (src, dst), each round written to the shared folder.

Distances and most walks carry a hop bound; :func:`reach` without one and the layers go on until nothing new is found. Kernels without a relational form
(bridges, longest simple paths, rings, pattern classes) run per connected component through ``applyInPandas``; a component
is bounded by the guard that the caller names, larger ones are reported as such.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascata.functions.scalars import haversine_km
from cascata.operators.components import connected_components
from cascata.session import materialize, passing

DIRECTIONS = ("downstream", "upstream", "either", "bidirectional")


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges (src, dst) to walk for a direction; a link counts as bidirectional when both of its directions are present."""
    plain = edges.select("src", "dst").where("src <> dst").distinct()
    back = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "downstream":
        return plain
    if direction == "upstream":
        return back
    if direction == "either":
        return plain.union(back).distinct()
    if direction == "bidirectional":
        return plain.join(back, ["src", "dst"], "left_semi")
    raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")


def reach(edges: DataFrame, max_hops: int | None, direction: str = "downstream", starts: DataFrame | None = None, allowed: DataFrame | None = None, first_edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, hop) with the least hop from 1 to ``max_hops`` (None: as far as edges lead); the start itself is left out.

    starts: column node, to walk only from some nodes. allowed: column node, nodes that a path may visit (its end included).
    first_edges: another adjacency for the first hop. Each round joins the new frontier only, and meets earlier rounds once.
    """
    step = oriented(edges, direction)
    if allowed is not None:
        step = step.join(allowed.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    step = materialize(step, "reach-edges")
    first = oriented(first_edges, direction) if first_edges is not None else step
    if starts is not None:
        first = first.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    found = materialize(first.select("src", "dst", F.lit(1).alias("hop")), "reach")
    frontier = found
    for hop in itertools.count(2) if max_hops is None else range(2, max_hops + 1):
        new = frontier.select("src", F.col("dst").alias("_mid")).join(step.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst").where("src <> dst").distinct()
        new = materialize(new.join(found, ["src", "dst"], "left_anti").select("src", "dst", F.lit(hop).alias("hop")), "reach")
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    return found


def nearest_matching(reached: DataFrame, matching: DataFrame) -> DataFrame:
    """Of the reached nodes that match (column node), only those at the least hop of each start; aggregation, then join."""
    hits = reached.join(matching.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    least = hits.groupBy("src").agg(F.min("hop").alias("hop"))
    return hits.join(least, ["src", "hop"]).select("src", "dst", "hop")


def multi_source_distance(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(node, distance) to the nearest source, undirected; sources have distance 0, unreached nodes no row."""
    step = materialize(mirrored(edges), "msd-edges")
    found = materialize(sources.select("node", F.lit(0).alias("distance")).distinct(), "msd")
    frontier = found
    for d in range(1, max_hops + 1):
        new = frontier.select(F.col("node").alias("src")).join(step, "src").select(F.col("dst").alias("node")).distinct()
        new = materialize(new.join(found, "node", "left_anti").select("node", F.lit(d).alias("distance")), "msd")
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    return found


def root_of(parents: DataFrame, node: str = "node", parent: str = "parent", max_rounds: int = 64) -> DataFrame:
    """(node, root, depth) for parent pointers (null: a root), by pointer doubling; a cycle takes its smallest node as root."""
    state = parents.select(F.col(node).alias("n"), F.coalesce(F.col(parent), F.col(node)).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    state = materialize(state, "roots")
    for _ in range(max_rounds):
        above = state.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        new = state.join(above, F.col("up") == F.col("_n"), "left").select("n", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        new = materialize(new, "roots")
        moved = new.join(state.select("n", F.col("up").alias("_was")), "n").where("up <> _was").limit(1).count()
        state = new
        if not moved:
            looped = state.where("n = up").join(parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("n")), "n", "left_semi").limit(1).count()
            if looped:
                break
            return state.select(F.col("n").alias("node"), F.col("up").alias("root"), "depth")
    comp = connected_components(parents.where(F.col(parent).isNotNull()), node, parent)
    return parents.select(F.col(node).alias("node")).join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("root"), F.lit(-1).alias("depth"))


def shared_neighbours(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Per pair (a < b): common neighbours, Jaccard, Adamic-Adar and resource allocation. of: pairs (a, b), else all links."""
    both = materialize(mirrored(edges.where("src <> dst")), "shared-edges")
    degree = both.groupBy("src").agg(F.count("*").alias("deg"))
    pairs = both.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")) if of is None else of.select("a", "b").distinct()
    left = pairs.join(both.select(F.col("src").alias("a"), F.col("dst").alias("m")), "a")
    common = left.join(both.select(F.col("src").alias("b"), F.col("dst").alias("m")), ["b", "m"]).join(degree.select(F.col("src").alias("m"), F.col("deg").alias("deg_m")), "m")
    sums = common.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(F.col("deg_m") > 1, 1 / F.log(F.col("deg_m").cast("double"))).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("deg_m")).alias("resource_allocation"))
    out = pairs.join(sums, ["a", "b"], "left").join(degree.select(F.col("src").alias("a"), F.col("deg").alias("deg_a")), "a").join(degree.select(F.col("src").alias("b"), F.col("deg").alias("deg_b")), "b")
    n = F.coalesce("common", F.lit(0))
    return out.select("a", "b", n.alias("common"), (n / (F.col("deg_a") + F.col("deg_b") - n)).alias("jaccard"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"), F.coalesce("resource_allocation", F.lit(0.0)).alias("resource_allocation"))


def project_links(links: DataFrame, ne_site: DataFrame) -> DataFrame:
    """Site edges (src, dst, direction, links) from element links (a_ne, z_ne): each unordered pair once, merged directions."""
    site = lambda end: ne_site.select(F.col("ne_id").alias(f"{end}_ne"), F.col("site_id").alias(f"{end}_site"))
    placed = links.join(site("a"), "a_ne").join(site("z"), "z_ne").where("a_site <> z_site")
    low, high = F.least("a_site", "z_site").alias("src"), F.greatest("a_site", "z_site").alias("dst")
    way = F.when(F.col("a_site") < F.col("z_site"), "->").otherwise("<-")
    merged = placed.select(low, high, way.alias("way")).groupBy("src", "dst").agg(F.count("*").alias("links"), F.count_if(F.col("way") == "->").alias("_to"), F.count_if(F.col("way") == "<-").alias("_from"))
    return merged.select("src", "dst", F.when((F.col("_to") > 0) & (F.col("_from") > 0), "<->").when(F.col("_to") > 0, "->").otherwise("<-").alias("direction"), "links")


def radius_pairs(points: DataFrame, key: str, km: float) -> DataFrame:
    """Pairs (a < b, km) within a great-circle distance: an equi join on 3-D grid cells of the sphere, then the exact distance.

    A cell is as wide as the chord of the radius, so that close points are in the same or in touching cells, at any latitude.
    """
    chord = 2 * math.sin(min(km / 6371.0, math.pi) / 2)
    axes = [F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat"))]
    cell = [F.floor(a / max(chord, 1e-9)).cast("long") for a in axes]
    p = points.select(F.col(key).alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), *[c.alias(f"_{i}") for i, c in enumerate(cell)])
    near = [F.explode(F.sequence(F.col(f"_{i}") - 1, F.col(f"_{i}") + 1)) for i in range(3)]
    for i in range(3):
        p = p.withColumn(f"c{i}", near[i])
    q = points.select(F.col(key).alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    pairs = p.drop("_0", "_1", "_2").join(q, ["c0", "c1", "c2"]).where("a < b")
    return pairs.withColumn("km", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("km") <= km).select("a", "b", "km")


def density_radius(pairs: DataFrame, k: int, scale: float, least: float, most: float) -> DataFrame:
    """Per node the distance to its k-th neighbour among ``pairs`` (a, b, km), scaled and clamped; fewer neighbours: the most."""
    both = pairs.select(F.col("a").alias("node"), "km").union(pairs.select(F.col("b").alias("node"), "km"))
    ordered = both.groupBy("node").agg(F.array_sort(F.collect_list("km")).alias("kms"))
    kth = F.when(F.size("kms") >= k, F.element_at("kms", k))
    return ordered.select("node", F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), kth * scale)), F.lit(most)).alias("radius_km"))


def smooth_levels(base: DataFrame, edges: DataFrame, anchors: DataFrame, alpha: float = 0.5, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Jacobi smoothing: alpha * base + (1 - alpha) * mean of neighbours; anchors keep their base; stops at ``tolerance``."""
    both = materialize(mirrored(edges), "smooth-edges")
    pinned = anchors.select("node", F.lit(True).alias("_pin"))
    level = materialize(base.join(pinned, "node", "left").select("node", "base", F.coalesce("_pin", F.lit(False)).alias("pin"), F.col("base").alias("level")), "smooth")
    for _ in range(rounds):
        mean = both.join(level.select(F.col("node").alias("dst"), F.col("level").alias("_l")), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("_l").alias("_mean"))
        moved = level.join(mean, "node", "left").withColumn("_new", F.when(F.col("pin") | F.col("_mean").isNull(), F.col("base")).otherwise(alpha * F.col("base") + (1 - alpha) * F.col("_mean")))
        moved = materialize(moved.select("node", "base", "pin", F.col("_new").alias("level"), F.abs(F.col("_new") - F.col("level")).alias("_step")), "smooth")
        level = moved.drop("_step")
        if (moved.agg(F.max("_step")).first()[0] or 0.0) < tolerance:
            break
    return level.select("node", "level")


def _adjacency(pdf: pd.DataFrame) -> dict:
    near: dict = defaultdict(set)
    for a, b in zip(pdf["a"], pdf["b"]):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def bridges_of(near: dict) -> set[tuple]:
    """Bridge edges (a < b) of an undirected graph, by depth-first low-links without recursion."""
    order, low, out, clock = {}, {}, set(), 0
    for start in sorted(near):
        if start in order:
            continue
        stack = [(start, None, iter(sorted(near[start])))]
        order[start] = low[start] = clock
        clock += 1
        while stack:
            node, parent, rest = stack[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = clock
                    clock += 1
                    stack.append((nxt, node, iter(sorted(near[nxt]))))
                    break
                if nxt != parent:
                    low[node] = min(low[node], order[nxt])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up]:
                        out.add((min(up, node), max(up, node)))
    return out


def _per_component(edges: DataFrame, kernel, schema: str) -> DataFrame:
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = materialize(pairs, "component-edges")
    comp = connected_components(pairs, "a", "b")
    tagged = pairs.join(comp.withColumnRenamed("node", "a"), "a")
    return tagged.groupBy("component").applyInPandas(kernel, schema)


def bridges(edges: DataFrame) -> DataFrame:
    """(component, a, b, is_bridge) for every undirected edge."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        found = bridges_of(_adjacency(pdf))
        return pdf.assign(is_bridge=[(a, b) in found for a, b in zip(pdf["a"], pdf["b"])])[["component", "a", "b", "is_bridge"]]

    return _per_component(edges, kernel, "component long, a long, b long, is_bridge boolean")


def strict_rings(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(a, b, direction) for the edges inside blocks that remain without bridges.

    The entry of a block is its only site that touches a bridge, else its highest scored one (ties: smallest). Edges at the
    entry point inwards, all others are '<->'; a block without a scored site has '<->' everywhere. scores: node, score.
    """
    marked = materialize(bridges(edges), "ring-bridges")
    inner = marked.where("not is_bridge").select("a", "b")
    blocks = connected_components(inner, "a", "b").withColumnRenamed("component", "block")
    outer = marked.where("is_bridge").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("edge", F.lit(True))
    members = blocks.join(outer, "node", "left").join(scores, "node", "left")
    entry = members.groupBy("block").agg(
        F.count_if("edge").alias("n"), F.max(F.when(F.col("edge"), F.col("node"))).alias("only"),
        F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("node")).alias("m")))).alias("best"),
    ).select("block", F.when(F.col("n") == 1, F.col("only")).otherwise(-F.col("best.m")).alias("entry"))
    named = inner.join(blocks.withColumnRenamed("node", "a"), "a").join(entry, "block")
    way = F.when(F.col("a") == F.col("entry"), "->").when(F.col("b") == F.col("entry"), "<-").otherwise("<->")
    return named.select("a", "b", "block", way.alias("direction"))


def pair_directions(pairs: DataFrame, sites: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(a, b, gap, margin, direction) from seven weighted votes on which end is upstream.

    pairs: a, b, is_bridge, shared. sites: node, core_distance, level, base, has_data, pair_data, neighbours. Every vote is the
    capped difference times its weight, but for Data presence and leaves, which count whole. |gap| below the margin is '<->'.
    """
    w = {"core": 2.0, "level": 0.8, "base": 0.5, "data": 2.0, "pair_data": 1.0, "neighbours": 0.4, "leaf": 1.2, "cap": 5.0} | (weights or {})
    side = lambda e: sites.select(*[F.col(c).alias(f"{e}_{c}") for c in sites.columns])
    j = pairs.join(side("l"), F.col("a") == F.col("l_node")).join(side("r"), F.col("b") == F.col("r_node"))
    diff = lambda c: F.col(f"l_{c}") - F.col(f"r_{c}")
    capped = lambda d, k: F.signum(d) * F.least(F.abs(d), F.lit(w["cap"])) * w[k]
    sign = lambda l, r: l.cast("int") - r.cast("int")
    gap = (
        capped(-diff("core_distance"), "core") + capped(diff("level"), "level") + capped(diff("base"), "base") + capped(diff("pair_data"), "pair_data")
        + capped(diff("neighbours"), "neighbours") + w["data"] * sign(F.col("l_has_data"), F.col("r_has_data")) + w["leaf"] * sign(F.col("r_neighbours") == 1, F.col("l_neighbours") == 1)
    )
    margin = F.lit(2.5) + F.when(F.col("is_bridge"), 0.0).otherwise(2.0) + 0.5 * F.least(F.col("shared"), F.lit(3))
    out = j.select("a", "b", gap.alias("gap"), margin.alias("margin"))
    return out.withColumn("direction", F.when(F.abs("gap") < F.col("margin"), "<->").when(F.col("gap") > 0, "->").otherwise("<-"))


def anchors(scores: DataFrame, ratio: float = 0.85, most: int = 3) -> DataFrame:
    """Per component the anchors among ``scores`` (component, node, score, has_data, neighbours).

    Where a component has Data sites, up to ``most`` of them whose score reaches ``ratio`` of their best, by score, then
    neighbours, then id, each descending; elsewhere the one best node.
    """
    best = F.max_by(F.struct("has_data", "score"), F.struct("has_data", "score"))
    top = scores.groupBy("component").agg(best.alias("_best"))
    good = scores.join(top, "component").where((F.col("has_data") == F.col("_best.has_data")) & (F.col("score") + 1e-9 >= ratio * F.col("_best.score")) | (~F.col("_best.has_data") & (F.col("score") == F.col("_best.score"))))
    order = Window.partitionBy("component").orderBy(F.desc("score"), F.desc("neighbours"), F.desc("node"))
    kept = good.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.when(F.col("_best.has_data"), most).otherwise(1))
    return kept.select("component", "node", "score")


def break_cycles(edges: DataFrame) -> DataFrame:
    """Directed edges (src, dst, weight) that stay after the weakest edge of each directed cycle goes (ties: smallest pair)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {(r.src, r.dst): r.weight for r in pdf.itertuples()}
        while True:
            cycle = _find_cycle(left)
            if not cycle:
                break
            del left[min(cycle, key=lambda e: (left[e], e))]
        return pd.DataFrame([(a, b, w) for (a, b), w in sorted(left.items())], columns=["src", "dst", "weight"])

    edges = materialize(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "cycles")
    comp = connected_components(edges, "src", "dst")
    return edges.join(comp.withColumnRenamed("node", "src"), "src").groupBy("component").applyInPandas(kernel, "src long, dst long, weight double")


def _find_cycle(edges: dict) -> list | None:
    out: dict = defaultdict(list)
    for a, b in sorted(edges):
        out[a].append(b)
    state: dict = {}
    for start in sorted(out):
        path, stack = [], [(start, iter(out[start]))]
        if state.get(start):
            continue
        state[start] = 1
        path.append(start)
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if state.get(nxt) == 1:
                    ring = path[path.index(nxt):] + [nxt]
                    return list(zip(ring, ring[1:]))
                if not state.get(nxt):
                    state[nxt] = 1
                    path.append(nxt)
                    stack.append((nxt, iter(out.get(nxt, ()))))
                    break
            else:
                state[node] = 2
                path.pop()
                stack.pop()
    return None


def rings_through(near: dict, a, b, max_depth: int, most: int) -> list[tuple]:
    """Cycles that hold both sites, as pairs of simple paths that share their ends only; ``most`` is a report limit."""
    paths: list[tuple] = []
    queue = deque([(a,)])
    while queue:
        path = queue.popleft()
        if path[-1] == b:
            paths.append(path)
            continue
        if len(path) <= max_depth:
            queue.extend(path + (n,) for n in sorted(near[path[-1]]) if n not in path)
    rings, seen = [], set()
    for i, p in enumerate(paths):
        for q in paths[i + 1 :]:
            if len(p) + len(q) > 4 and not set(p[1:-1]) & set(q[1:-1]):
                mark = frozenset(p) | frozenset(q)
                if mark not in seen:
                    seen.add(mark)
                    rings.append(p + q[-2:0:-1])
                if len(rings) >= most:
                    return rings
    return rings


def longest_path(near: dict, guard: int = 18) -> list:
    """The longest simple path of a small undirected graph, exact by dynamic programming over node sets; beyond the guard empty.

    Chains and rings take a linear way at any size. Among equal lengths the smallest node sequence wins.
    """
    nodes = sorted(near)
    ends = [n for n in nodes if len(near[n]) == 1]
    if nodes and all(len(near[n]) <= 2 for n in nodes):
        start = ends[0] if ends else nodes[0]
        path, seen = [start], {start}
        while nxt := sorted(n for n in near[path[-1]] if n not in seen):
            path.append(nxt[0])
            seen.add(nxt[0])
        return path
    if len(nodes) > guard or not nodes:
        return []
    index = {n: i for i, n in enumerate(nodes)}
    best: dict[tuple[int, int], list] = {(1 << i, i): [n] for i, n in enumerate(nodes)}
    top = min(best.values())
    while best:
        longer: dict[tuple[int, int], list] = {}
        for (mask, last), path in best.items():
            for n in near[nodes[last]]:
                bit = 1 << index[n]
                if not mask & bit:
                    key = (mask | bit, index[n])
                    new = [*path, n]
                    if key not in longer or new < longer[key]:
                        longer[key] = new
        if longer:
            top = min(longer.values())
        best = longer
    return top


def pattern_class(component: list, offline: set, bidirectional: dict, upstream: dict, downstream: dict, routers: set, absorbed: set | None = None) -> str:
    """Fault pattern of one component of offline sites; see the survey's pattern rules."""
    absorbed = absorbed or set()
    if any(s not in routers for s in component):
        return "unknown"
    beyond = lambda s: {n for n in bidirectional.get(s, set()) | upstream.get(s, set()) if n not in offline}
    if len(component) == 1:
        n = len(beyond(component[0]))
        if n == 1 and absorbed:
            return "ip_chain_single_link"
        return "ip_chain_multi_link" if n >= 2 else "unknown"
    side = lambda s: bidirectional.get(s, set()) | upstream.get(s, set())
    if all(len(side(s)) == 2 for s in component):
        return "ip_ring_single_upstream"
    near = {s: {n for n in side(s) | downstream.get(s, set()) if n in set(component)} for s in component}
    path = longest_path(near)
    if len(path) >= 2:
        inner, ends = path[1:-1], (path[0], path[-1])
        if all(len(side(s)) == 2 for s in inner) and any(len(side(s)) != 2 for s in ends) and beyond(ends[0]) & beyond(ends[1]):
            return "ip_ring_multi_upstream"
    return "ip_ring_others" if path else "unknown"


def lowest_common_upstream(reached: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, root) upstream sites common to all sites of a group with the least (total, largest) hops; ties all stay.

    reached: src, dst, hop of an upstream closure. groups: group_id, site. A site counts as its own root at hop 0.
    """
    own = groups.select("group_id", "site", F.col("site").alias("root"), F.lit(0).alias("hop"))
    up = groups.join(reached, groups.site == reached.src).select("group_id", "site", F.col("dst").alias("root"), "hop")
    size = groups.groupBy("group_id").agg(F.countDistinct("site").alias("_n"))
    common = own.unionByName(up).groupBy("group_id", "root").agg(F.countDistinct("site").alias("n"), F.sum("hop").alias("total"), F.max("hop").alias("far"))
    common = common.join(size, "group_id").where("n = _n")
    least = common.groupBy("group_id").agg(F.min(F.struct("total", "far")).alias("_b"))
    return common.join(least, "group_id").where((F.col("total") == F.col("_b.total")) & (F.col("far") == F.col("_b.far"))).select("group_id", "root", "total", "far")


def path_lengths(edges: DataFrame, pairs: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs (a, b) whose undirected distance is within [least, most] hops, with it."""
    found = reach(edges, most, "either", starts=pairs.select(F.col("a").alias("node")))
    return pairs.join(found.withColumnsRenamed({"src": "a", "dst": "b"}), ["a", "b"]).where(F.col("hop") >= least)


def _layers_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, src, least) of a part's nodes, src null in a node's own row: the layers that follow from that part alone."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    layer, waits, after = {}, {}, defaultdict(list)
    for node, src, least in zip(rows["node"].to_pylist(), rows["src"].to_pylist(), rows["least"].to_pylist()):
        if src is None:
            layer[node] = least
        else:
            waits[node] = waits.get(node, 0) + 1
            after[src].append(node)
    ready = [n for n in layer if n not in waits]
    for node in ready:  # grows while it is read
        for dst in after.get(node, ()):
            layer[dst] = max(layer[dst], layer[node] + 1)
            waits[dst] -= 1
            if not waits[dst]:
                ready.append(dst)
    yield pa.RecordBatch.from_arrays([pa.array(ready, rows.schema.field("node").type), pa.array([layer[n] for n in ready], pa.int32())], names=["node", "layer"])


def layered_order(edges: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(node, layer): layer 0 has no upstream; others are one below their deepest upstream; nodes on and below cycles stay out.

    Nodes are dealt by ranges to parts of about ``part`` rows, each with the edges into it. A round orders in each part all that
    follows from what it holds, and hands the layers on; so there are as many rounds as a path changes parts, not a round for
    each layer, and one when everything fits into one part. Edges with a null end are left out.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    edges = edges.where("src is not null and dst is not null")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    with passing(spark) as keep:
        left = materialize(edges.select("src", "dst").distinct(), "layers")
        pending = materialize(nodes.select("node", F.lit(0).alias("least")), "layers")
        done = pending.limit(0).select("node", F.col("least").alias("layer"))
        rounds = 0
        while n := pending.count():
            rows = pending.select("node", F.lit(None).cast(kind).alias("src"), "least").unionByName(left.select(F.col("dst").alias("node"), "src", F.lit(None).cast("int").alias("least")))
            parts = -(-(n + left.count()) // part)
            dealt = rows.repartitionByRange(parts, "node") if parts > 1 else rows.repartition(1)
            found = materialize(dealt.mapInArrow(_layers_here, f"node {kind}, layer int"), "layers")
            if found.isEmpty():
                break
            done, rounds = done.unionByName(found), rounds + 1
            if rounds % 32 == 0:  # keeps the plan of many rounds short
                done = materialize(done, "layers")
            known = found.withColumnsRenamed({"node": "src"})
            reached = left.join(known, "src").groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("_r"))
            pending = pending.join(found, "node", "left_anti").join(reached, "node", "left")
            pending = materialize(pending.select("node", F.greatest("least", F.coalesce("_r", F.lit(0))).alias("least")), "layers")
            left = materialize(left.join(known, "src", "left_anti").select("src", "dst"), "layers")
        return keep(materialize(done, "layers"))


def power_iteration(target: np.ndarray, source: np.ndarray, weight: np.ndarray, size: int, rounds: int = 80, tolerance: float = 1e-6) -> float:
    """Spectral radius of a non-negative matrix, given by its filled cells."""
    v, last = np.full(size, 1 / math.sqrt(max(1, size))), 0.0
    for _ in range(rounds):
        w = np.bincount(target, weight * v[source], size)
        norm = float(np.linalg.norm(w))
        if norm == 0:
            return 0.0
        v = w / norm
        if abs(norm - last) <= tolerance * max(1.0, norm):
            return norm
        last = norm
    return last


def spectral_radius(edges: DataFrame, rounds: int = 80, tolerance: float = 1e-6, most: int = 1_000_000) -> float:
    """Spectral radius of edges (target, source, alpha): on the driver up to ``most`` of them, beyond by a join and an aggregation a round."""
    if edges.count() <= most:
        cells = edges.select("target", "source", "alpha").toArrow()
        names = {x: i for i, x in enumerate(dict.fromkeys(cells["target"].to_pylist() + cells["source"].to_pylist()))}
        ends = [np.array([names[x] for x in cells[c].to_pylist()], np.int64) for c in ("target", "source")]
        return power_iteration(*ends, np.asarray(cells["alpha"], float), len(names), rounds, tolerance)
    nodes = edges.select(F.col("target").alias("node")).union(edges.select("source")).distinct()
    v = materialize(nodes.withColumn("v", F.lit(1.0)), "radius")
    scale, last = math.sqrt(v.count()), 0.0
    for _ in range(rounds):
        w = edges.join(v, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg((F.sum(F.col("alpha") * F.col("v")) / scale).alias("v"))
        v = materialize(w, "radius")
        scale = math.sqrt(v.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)
        if scale == 0 or abs(scale - last) <= tolerance * max(1.0, scale):
            return scale
        last = scale
    return last
