import datetime
import itertools
import random

import pytest

from cascata.operators import graph as G
from cascata.operators import topology as T
from cascata.operators.components import connected_components
from cascata.queries import graphs
from cascata.session import materialize


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def brute_bridges(pairs):
    def parts(es):
        up = {}

        def find(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b in es:
            up[find(a)] = find(b)
        return len({find(x) for e in pairs for x in e})

    return {e for e in pairs if parts([x for x in pairs if x != e]) > parts(pairs)}


@pytest.mark.parametrize("seed", range(3))
def test_bridges_and_components(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(32)})
    got = {(r.a, r.b) for r in G.bridges(edges(spark, pairs)).where("is_bridge").collect()}
    assert got == brute_bridges(pairs)
    comp = {r.node: r.component for r in connected_components(edges(spark, pairs + [(7, 7)])).collect()}
    for a, b in pairs:
        assert comp[a] == comp[b] <= min(a, b)


def test_long_chain_component(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    comp = connected_components(edges(spark, list(zip(order, order[1:]))))
    assert {r.component for r in comp.collect()} == {0} and comp.count() == n


def test_reach_on_a_cycle(spark):
    got = {(r.src, r.dst): r.hop for r in G.reach(edges(spark, [(1, 2), (2, 3), (3, 1)]), 9, "downstream").collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2}
    both = {(r.src, r.dst) for r in G.reach(edges(spark, [(1, 2), (2, 1), (2, 3)]), 3, "bidirectional").collect()}
    assert both == {(1, 2), (2, 1)}


def test_pointer_cycles_are_one_component(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, None)], "node long, parent long")
    assert {r.node: r.root for r in G.root_of(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_strict_ring_entry(spark):
    ring = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    scores = spark.createDataFrame([(1, 5.0), (2, 9.0), (6, 1.0)], "node long, score double")
    got = {(r.a, r.b): r.direction for r in G.strict_rings(edges(spark, ring), scores).collect()}
    assert got == {(1, 2): "<->", (2, 3): "<-", (1, 3): "<-", (4, 5): "->", (5, 6): "<->", (4, 6): "->"}


def test_cycle_break_removes_the_weakest(spark):
    rows = spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0), (3, 1, 2.0), (3, 4, 9.0)], "src long, dst long, weight double")
    assert {(r.src, r.dst) for r in G.break_cycles(rows).collect()} == {(1, 2), (3, 1), (3, 4)}


@pytest.mark.parametrize("seed", range(4))
def test_longest_path_is_exact(seed):
    rng = random.Random(seed)
    near = {i: set() for i in range(7)}
    for a, b in itertools.combinations(range(7), 2):
        if rng.random() < 0.4:
            near[a].add(b)
            near[b].add(a)
    best = max(len(p) for k in range(1, 8) for p in itertools.permutations(range(7), k) if all(b in near[a] for a, b in zip(p, p[1:])))
    assert len(G.longest_path(near)) == best
    assert G.longest_path({i: {(i + 1) % 30, (i - 1) % 30, (i + 2) % 30} for i in range(30)}) == []


def test_rings_and_patterns():
    near = {1: {2, 4}, 2: {1, 3}, 3: {2, 4}, 4: {1, 3}}
    assert len(G.rings_through(near, 1, 3, 4, 10)) == 1
    assert G.pattern_class([1], {1}, {1: {8, 9}}, {}, {}, {1}) == "ip_chain_multi_link"
    assert G.pattern_class([1], {1}, {}, {1: {9}}, {}, {1}, {5}) == "ip_chain_single_link"
    assert G.pattern_class([1], {1}, {}, {}, {}, set()) == "unknown"
    assert G.pattern_class([1, 2], {1, 2}, {1: {2, 9}, 2: {1, 8}}, {}, {}, {1, 2}) == "ip_ring_single_upstream"


def test_anchors_and_radius(spark):
    rows = [(1, 1, 10.0, False, 9), (1, 2, 9.0, True, 1), (1, 3, 8.0, True, 1), (1, 4, 7.0, True, 1), (2, 5, 3.0, False, 1), (2, 6, 3.0, False, 2), (2, 7, 3.0, False, 2), (3, 8, 2.0, True, 1), (3, 9, 2.0, True, 1), (3, 10, 2.0, True, 1), (3, 11, 2.0, True, 2)]
    s = spark.createDataFrame(rows, "component long, node long, score double, has_data boolean, neighbours long")
    assert [r.node for r in G.anchors(s).orderBy("node").collect()] == [2, 3, 7, 9, 10, 11]
    assert G.anchors(s.limit(0)).count() == 0
    p = spark.createDataFrame([(1, 2, 5.0), (1, 3, 7.0)], "a long, b long, km double")
    assert {r.node: r.radius_km for r in G.density_radius(p, 2, 1.5, 1.0, 50.0).collect()} == {1: 10.5, 2: 50.0, 3: 50.0}


def test_layers_go_on_to_the_end_of_a_chain(spark, tmp_path):
    n = 63
    spark.createDataFrame([(1001 + 2 * i, 1) for i in range(n)], "s_suppkey long, s_nationkey long").coalesce(1).write.parquet(f"file://{tmp_path}/supplier.parquet")
    got = {r.node: r.layer for r in graphs.layered_order(spark, f"file://{tmp_path}").collect()}
    assert got == {1001 + 2 * i: i for i in range(n)}


def test_layers_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    chain = [(i, i + 1) for i in range(2000)] + [(5, 900), (3000, 1500), (2000, 4000), (4000, 4001), (4001, 4000), (4001, 4002), (None, 7), (9, None)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    want = {i: i for i in range(2001)} | {3000: 0}
    assert {r.node: r.layer for r in G.layered_order(edges).collect()} == want and len(rounds) < 12
    rounds.clear()
    assert {r.node: r.layer for r in G.layered_order(edges, 700).collect()} == want and len(rounds) < 60
    assert G.layered_order(edges.limit(0)).count() == 0


def test_common_upstream_at_any_depth(spark, tmp_path):
    deep = 3**14
    keys = [deep // 3**k for k in range(15)] + [4]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    day = datetime.date(1995, 3, 1)
    spark.createDataFrame([(deep, 2e5, day, "5-LOW"), (4, 2e5, day, "5-LOW")], "o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string").coalesce(1).write.parquet(f"file://{tmp_path}/orders.parquet")
    assert [tuple(r) for r in graphs.common_upstream(spark, f"file://{tmp_path}").collect()] == [("5-LOW-1995-3", 1, 15, 14)]


def test_misconnections_and_core_scores(spark):
    e = spark.createDataFrame(
        [(1, "A", "DATA"), (2, "B", "RAN"), (3, "B", "TRANSMISSION"), (4, "C", "RAN"), (5, "C", "TRANSMISSION"), (6, "D", "RAN"), (7, "E", "DATA"), (8, "E", "TRANSMISSION"), (9, None, "DATA"), (10, "F", None)],
        "ne_id long, site string, domain string",
    )
    # A-B by transmission only; A-C also by DATA and RAN; D has no transmission; E is a backbone site; 9 has no site.
    links = spark.createDataFrame([(1, 3), (3, 1), (5, 1), (1, 4), (1, 6), (1, 8), (9, 3), (2, 3), (1, 10), (1, 1)], "src long, dst long")
    assert [tuple(r) for r in T.misconnection_pairs(e, links).collect()] == [("A", "B")]
    got = {r.node: (round(r.score, 6), r.has_data, r.neighbours) for r in T.core_scores(e, links).collect()}
    # A: bonus 6, one DATA element, 5 neighbours, 6 links, each with a DATA end of its own.
    assert got["A"] == (round(6 + 1.5 + 5 * 0.8 + 6 * 0.6 + 6 * 1.2, 6), True, 5)
    assert got["B"] == (round(0.8 + 0.6 + 0.4, 6), False, 1)
    assert got["F"] == (round(0.8 + 0.6, 6), False, 1)
    assert T.misconnection_pairs(e.limit(0), links).count() == T.core_scores(e.limit(0), links).count() == 0
