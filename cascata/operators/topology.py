"""Building and filtering element and site graphs, anchors of alarms in them, and adjacency of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.operators.graph import mirrored, multi_source_distance, reach
from cascata.session import materialize

#: Device domains that the models cover, and what other domains are to links across sites.
MODELLED_DOMAINS = ("RAN", "TRANSMISSION", "DATA")


def ne_graph(links: DataFrame) -> DataFrame:
    """(src, dst, layer, direction) of deduplicated links (a_ne, z_ne, layer): both ends list a link, seen from their side.

    Names are trimmed and upper-cased; links without both ends are left out. A layer with links both ways is '<->'.
    """
    clean = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    named = links.select(clean("a_ne").alias("a"), clean("z_ne").alias("z"), clean("layer").alias("layer")).where("a <> '' and z <> ''").distinct()
    ways = named.select(F.col("a").alias("src"), F.col("z").alias("dst"), "layer", F.lit(1).alias("out")).unionByName(named.select(F.col("z").alias("src"), F.col("a").alias("dst"), "layer", F.lit(0).alias("out")))
    each = ways.groupBy("src", "dst", "layer").agg(F.max("out").alias("_to"), F.min("out").alias("_from"))
    return each.select("src", "dst", "layer", F.when(F.col("_to") != F.col("_from"), "<->").when(F.col("_to") == 1, "->").otherwise("<-").alias("direction"))


def downstream_sites(graph: DataFrame, ne_site: DataFrame) -> DataFrame:
    """(site, downstream) from an element graph: '<-' puts the target's site below the source's, '->' the other way; every site is listed, with null if nothing is below."""
    named = ne_site.select("ne_id", F.trim("site_id").alias("site_id")).where("site_id <> ''")
    placed = graph.join(named.select(F.col("ne_id").alias("src"), F.col("site_id").alias("s")), "src").join(named.select(F.col("ne_id").alias("dst"), F.col("site_id").alias("t")), "dst").where("s <> t")
    down = placed.where(F.col("direction").contains("<-")).select(F.col("s").alias("site"), F.col("t").alias("downstream"))
    up = placed.where(F.col("direction").contains("->")).select(F.col("t").alias("site"), F.col("s").alias("downstream"))
    return named.select(F.col("site_id").alias("site")).distinct().join(down.union(up).distinct(), "site", "left")


def links_within(links: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Links both of whose ends are among ``nodes`` (node)."""
    end = nodes.select("node").distinct()
    return links.join(end.select(F.col("node").alias(src)), src, "left_semi").join(end.select(F.col("node").alias(dst)), dst, "left_semi")


def within_regions(elements: DataFrame, links: DataFrame, regions: list) -> tuple[DataFrame, DataFrame]:
    """Elements (ne_id, region, ...) of some regions, and the links between them."""
    kept = elements.where(F.col("region").isin(*regions))
    return kept, links_within(links, kept.select(F.col("ne_id").alias("node")))


def with_domain(events: DataFrame, ne_domain: DataFrame, domains: tuple[str, ...] = MODELLED_DOMAINS) -> DataFrame:
    """Every event with its element's domain and whether the models cover it; elements without one are UNKNOWN_DEVICE."""
    joined = events.join(ne_domain.select(F.col("ne_id").alias("ne"), "domain"), "ne", "left")
    return joined.withColumn("domain", F.coalesce("domain", F.lit("UNKNOWN_DEVICE"))).withColumn("modelled", F.col("domain").isin(*domains))


def eligible_link(src_domain: Column, dst_domain: Column, src_role: Column, dst_role: Column, src_only: Column, dst_only: Column) -> Column:
    """Whether a link across sites tells about their order: equal domains, or a wireless element of a wireless-only site and a wireless or router element."""
    peer = lambda role: role.isin("wireless", "router")
    return (src_domain == dst_domain) | (src_only & (src_role == "wireless") & peer(dst_role)) | (dst_only & (dst_role == "wireless") & peer(src_role))


def wireless_only_sites(elements: DataFrame) -> DataFrame:
    """(site) whose elements (site, role) are all wireless."""
    return elements.groupBy("site").agg(F.min((F.col("role") == "wireless").cast("int")).alias("_all")).where("_all = 1").select("site")


def isolated_sites(elements: DataFrame, links: DataFrame, domain: str = "TRANSMISSION") -> DataFrame:
    """(site, elements): sites with elements of ``domain`` none of whose elements links to another site or an unknown element.

    elements: ne_id, site, domain. links: src, dst, as each end lists them.
    """
    place = elements.select(F.col("ne_id").alias("dst"), F.col("site").alias("t"))
    out = links.where("src <> dst").join(elements.select(F.col("ne_id").alias("src"), "site"), "src").join(place, "dst", "left")
    open_sites = out.where("t is null or t <> site").select("site").distinct()
    return elements.where(F.col("domain") == domain).groupBy("site").agg(F.count("*").alias("elements")).join(open_sites, "site", "left_anti")


def device_counts(elements: DataFrame, domains: list[str]) -> DataFrame:
    """One row per site with a column of element counts per domain."""
    return elements.groupBy("site").pivot("domain", domains).agg(F.count("domain")).na.fill(0, domains)


def endpoints(alarms: DataFrame, peers: DataFrame) -> DataFrame:
    """``alarms`` (ne, port, ...) with remote_ne and remote_port of the link at their port; null where none is known."""
    index = peers.select(F.upper(F.trim("ne")).alias("_ne"), F.trim("port").alias("_port"), "remote_ne", "remote_port").dropDuplicates(["_ne", "_port"])
    return alarms.join(index, (F.upper(F.trim("ne")) == F.col("_ne")) & (F.trim("port") == F.col("_port")), "left").drop("_ne", "_port")


def peer_on_site(alarms: DataFrame, peers: DataFrame, ne_site: DataFrame) -> DataFrame:
    """Link alarms (ne, port, related_site, ...) whose port's peer element lies on the related site."""
    at = ne_site.select(F.col("ne_id").alias("remote_ne"), F.col("site_id").alias("_site"))
    return endpoints(alarms, peers).join(at, "remote_ne").where(F.col("_site") == F.col("related_site")).drop("_site")


def near_anchor(events: DataFrame, ne_site: DataFrame, ne_links: DataFrame, hops: int) -> DataFrame:
    """Events (anchor_site, ne, ...) whose element is at most ``hops`` links from an element of the anchor site."""
    anchors = ne_site.select(F.col("site_id").alias("anchor_site"), F.col("ne_id").alias("node")).join(events.select("anchor_site").distinct(), "anchor_site", "left_semi")
    near = anchors.select("anchor_site", F.col("node").alias("ne"))
    if hops:
        walked = reach(ne_links, hops, "either", starts=anchors.select("node"))
        near = near.union(anchors.join(walked, anchors.node == walked.src).select("anchor_site", F.col("dst").alias("ne"))).distinct()
    return events.join(near, ["anchor_site", "ne"], "left_semi")


def mutual_pairs(pairs: DataFrame, ne_links: DataFrame, hops: int) -> DataFrame:
    """Pairs (left_ne, right_ne, ...) of elements at most ``hops`` links apart."""
    same = pairs.where("left_ne = right_ne")
    if not hops:
        return same
    starts = pairs.select(F.col("left_ne").alias("node")).distinct()
    near = reach(ne_links, hops, "either", starts=starts).select(F.col("src").alias("left_ne"), F.col("dst").alias("right_ne"))
    return same.unionByName(pairs.where("left_ne <> right_ne").join(near, ["left_ne", "right_ne"], "left_semi").select(*same.columns))


def nth_neighbours(edges: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(node) at exactly ``n`` links from the nearest of ``starts`` (node), links taken either way."""
    return multi_source_distance(edges, starts, n).where(F.col("distance") == n).select("node")


def chain_tree(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, hop, parent): the breadth-first tree below each start; of several parents the smallest."""
    found = reach(edges, max_hops, "downstream", starts=starts).withColumnsRenamed({"src": "start", "dst": "node"})
    found = materialize(found.unionByName(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct()), "chain")
    steps = edges.where("src <> dst").select(F.col("src").alias("parent"), F.col("dst").alias("node")).distinct()
    above = found.select("start", F.col("node").alias("parent"), (F.col("hop") + 1).alias("hop"))
    parents = found.join(steps, "node").join(above, ["start", "parent", "hop"]).groupBy("start", "node").agg(F.min("parent").alias("parent"))
    return found.where("hop > 0").join(parents, ["start", "node"]).select("start", "node", "hop", "parent")


def component_adjacency(members: DataFrame, edges: DataFrame, hops: int, close: DataFrame | None = None) -> DataFrame:
    """(left, right, reason) of adjacent components, left < right: 'shared_site', else 'hop', else 'distance'.

    members: component, site. edges: src, dst. close: site pairs (src, dst) within the density radius, each way.
    """
    sites = members.select("component", "site").distinct()
    met = sites.select(F.col("component").alias("left"), F.col("site").alias("src")), sites.select(F.col("component").alias("right"), F.col("site").alias("dst"))

    def through(pairs: DataFrame, rank: int) -> DataFrame:
        return met[0].join(pairs.select("src", "dst"), "src").join(met[1], "dst").where(F.col("left") < F.col("right")).select("left", "right", F.lit(rank).alias("rank"))

    found = through(sites.select(F.col("site").alias("src"), F.col("site").alias("dst")).distinct(), 0)
    if hops:
        found = found.unionByName(through(reach(edges, hops, "either", starts=sites.select(F.col("site").alias("node"))), 1))
    if close is not None:
        found = found.unionByName(through(mirrored(close), 2))
    names = F.array(F.lit("shared_site"), F.lit("hop"), F.lit("distance"))
    return found.groupBy("left", "right").agg(F.min("rank").alias("_r")).select("left", "right", F.element_at(names, F.col("_r") + 1).alias("reason"))


def latest_peers(links: DataFrame) -> DataFrame:
    """(ne, port, remote_ne, remote_port) of both ends of each link (a_ne, a_port, z_ne, z_port, modified); the last change of a port counts."""
    ends = links.select(F.col("a_ne").alias("ne"), F.col("a_port").alias("port"), F.col("z_ne").alias("remote_ne"), F.col("z_port").alias("remote_port"), "modified")
    ends = ends.unionByName(links.select(F.col("z_ne").alias("ne"), F.col("z_port").alias("port"), F.col("a_ne").alias("remote_ne"), F.col("a_port").alias("remote_port"), "modified"))
    last = ends.groupBy("ne", "port").agg(F.max(F.struct("modified", "remote_ne", "remote_port")).alias("m"))
    return last.select("ne", "port", "m.remote_ne", "m.remote_port")


def _crossing(elements: DataFrame, links: DataFrame) -> DataFrame:
    """(site, domain, far_site, far_domain) of each end of each distinct link between elements of different sites."""
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    ends = elements.where("site is not null")
    left, right = (ends.select(F.col("ne_id").alias(k), F.col("site").alias(f"{k}_site"), F.col("domain").alias(f"{k}_domain")) for k in "ab")
    placed = pairs.join(left, "a").join(right, "b").where("a_site <> b_site")
    side = lambda x, y: F.struct(F.col(f"{x}_site").alias("site"), F.col(f"{x}_domain").alias("domain"), F.col(f"{y}_site").alias("far_site"), F.col(f"{y}_domain").alias("far_domain"))
    return placed.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).select("e.*")


def misconnection_pairs(elements: DataFrame, links: DataFrame) -> DataFrame:
    """(site_a, site_b), site_a the smaller, of links that are likely wrong.

    One site has DATA elements, the other TRANSMISSION and RAN but no DATA elements; a link with a TRANSMISSION end joins
    them and none joins DATA with RAN.
    """
    has = lambda d: F.max(F.coalesce(F.col("domain") == d, F.lit(False)))
    kinds = elements.where("site is not null").groupBy("site").agg(has("DATA").alias("data"), (~has("DATA") & has("RAN") & has("TRANSMISSION")).alias("access"))
    core, access = kinds.where("data").select("site"), kinds.where("access").select(F.col("site").alias("far_site"))
    facing = _crossing(elements, links).join(core, "site", "left_semi").join(access, "far_site", "left_semi")
    wired = F.max(F.col("domain").eqNullSafe("TRANSMISSION") | F.col("far_domain").eqNullSafe("TRANSMISSION"))
    vouched = F.max((F.col("domain").eqNullSafe("DATA") & F.col("far_domain").eqNullSafe("RAN")) | (F.col("domain").eqNullSafe("RAN") & F.col("far_domain").eqNullSafe("DATA")))
    found = facing.groupBy("site", "far_site").agg(wired.alias("wired"), vouched.alias("vouched")).where("wired and not vouched")
    return found.select(F.least("site", "far_site").alias("site_a"), F.greatest("site", "far_site").alias("site_b"))


#: What counts how much in a site's core score.
CORE_WEIGHTS = {"data_site": 6.0, "data_elements": 1.5, "neighbours": 0.8, "links": 0.6, "data_ends": 1.2, "transmission_ends": 0.4}


def core_scores(elements: DataFrame, links: DataFrame, weights: dict[str, float] = CORE_WEIGHTS) -> DataFrame:
    """(node, score, has_data, neighbours) of each site: weighted counts of its DATA elements, neighbour sites and links to them."""
    count = lambda c: F.count(F.when(c, 1))
    own = elements.where("site is not null").groupBy("site").agg(count(F.col("domain") == "DATA").alias("data_elements"))
    ends = _crossing(elements, links).groupBy("site", "far_site").agg(F.count("*").alias("links"), count(F.col("domain") == "DATA").alias("data_ends"), count(F.col("domain") == "TRANSMISSION").alias("transmission_ends"))
    seen = ends.groupBy("site").agg(F.count("*").alias("neighbours"), *[F.sum(c).alias(c) for c in ("links", "data_ends", "transmission_ends")])
    all_of = own.join(seen, "site", "left").na.fill(0).withColumn("data_site", (F.col("data_elements") > 0).cast("int"))
    score = sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0))
    return all_of.select(F.col("site").alias("node"), score.alias("score"), (F.col("data_elements") > 0).alias("has_data"), "neighbours")
