"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascata.session import materialize, passing

#: Up to so many distinct edges between numbers (16 bytes each) go through one task instead of rounds of joins.
ONE_TASK = 1 << 19


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, components) of the edges (u, v): roots hook to smaller roots, and only edges between roots go on."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[x], up[y]
        x, y = np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if not len(x):
            return nodes, nodes[up]
        np.minimum.at(up, x, y)
        while (up[up] != up).any():
            up = up[up]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if ends:
        nodes, found = smallest_reachable(*(np.concatenate(e) for e in zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Alternates two rewrites of the edge list until it is a set of stars: every node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. The number of rounds grows with the logarithm of the longest path; the
    list never has more rows than at first; a hot node's rows are combined before the shuffle. Each round is written to
    the shared folder, and nothing is collected but a count. Self-loops and null ends only add their node.

    Each round plans, compiles and tracks a dozen joins and stages in the driver. Edges between numbers that a count
    shows to be at most ``ONE_TASK`` take one task of an executor instead, with the same result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).where("node is not null").distinct()
    links = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null").distinct()  # neither sees a null beside a node
    with passing(spark) as keep:
        links = materialize(links, "cc")
        if {kind for _, kind in links.dtypes} == {"bigint"} and links.count() <= ONE_TASK:
            return keep(materialize(links.coalesce(1).mapInArrow(_one_task, "node long, component long"), "cc"))
        links = links.where("u <> v")
        before = None
        for _ in range(max_rounds):
            both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
            links = materialize(small, "cc")
            state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
            if state == before or state[0] == 0:
                break
            before = state
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        stars = keep(materialize(links, "cc"))
    return nodes.join(stars, nodes.node == stars.u, "left").select("node", F.coalesce("v", "node").alias("component"))
