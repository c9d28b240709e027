"""Mixing sources to target weights by subset-sum budget fitting.

1. Source sizes in words; sources in code-point order (null last) weigh 5, 2, 1, repeating. They share 150 % of all words
   by weight; no target exceeds twice its source, and the excess is shared again by weight until none does.
2. What a source needs beyond whole passes over its documents is a budget. Its documents are counted by exact length, and a
   bounded-knapsack dynamic programme over the counts fills the budget (``fit_counts``: over all counts for small budgets;
   for others the counts are apportioned first, and the programme adds and takes back documents for the rest). This works
   on (length, count) rows only, so that a source costs memory by its number of lengths, never by its number of documents.
3. Within each length, the documents with the smallest seeded hash are taken. Hash bins spread equal lengths of a hot
   source over many groups: whole bins first, and ranks only matter within a bin.

Null text has no words and is never taken. Null sources are one source. Rows that repeat a doc_id count each. Reruns
agree, as every choice follows from the seed and doc_id. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cascata.llm.common import word_count
from cascata.operators.ranking import running_totals
from cascata.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20240101
BINS = 1024
#: Up to this budget the programme runs over all documents; beyond, it fits the last words within RESERVE of the budget.
WHOLE, RESERVE = 1 << 16, 8192


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``, however many sources there are.

    A source is full when the common level reaches its cap by weight. In the order of that ratio, the words that sources
    take when the level is at a row's ratio are a running total, so that the last row the budget covers gives the level.
    """
    cap = F.col("source_size") * F.lit(float(most))
    named = running_totals(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(named.withColumn("weight", weight), "mix-weights")
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * float(total or 0)
    ratio = cap / F.col("weight")
    filled = running_totals(weighed.withColumn("_ratio", ratio), [F.col("_ratio"), F.col("_rank")], {"_caps": cap, "_weights": F.col("weight")}, "mix-levels")
    reached = F.col("_caps") + F.col("_ratio") * (F.lit(all_weights or 0.0) - F.col("_weights")) <= F.lit(budget)
    last = filled.where(reached).agg(F.max(F.struct("_weights", "_caps")).alias("m")).first()["m"]
    used, left = (last["_caps"], (all_weights or 0.0) - last["_weights"]) if last else (0.0, all_weights or 0.0)
    level = (budget - used) / left if left > 0 else float("inf")
    return weighed.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or just below where none do.

    A bounded-knapsack programme over all counts up to a budget of ``WHOLE`` words, which is exact. Beyond, the budget is
    first apportioned to the lengths; the programme then fits what is left by adding documents and taking others back,
    as long as the sum stays within ``reserve`` words (twice the greatest length, if more) of the budget. That is exact
    wherever the best sum can be reached so, which a handful of short documents is enough for.
    """
    sizes, counts = sizes.astype(object), counts.astype(object)  # whole numbers of any magnitude
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget >= total:
        return counts.astype(np.int64)
    take, left, span = np.zeros(len(counts), object), budget, 0
    if budget > WHOLE:
        span = int(max(reserve, 2 * max(sizes)))
        take = np.array([n * budget // total for n in counts], dtype=object)
        left = budget - sum(s * k for s, k in zip(sizes, take))
        for i in np.argsort(-sizes.astype(np.int64), kind="stable"):
            more = min(counts[i] - take[i], max(0, left - span) // sizes[i])
            take[i] += more
            left -= more * sizes[i]
    target = int(left + span)  # bit b stands for b - span words more than are taken now
    mask, reached, via, steps = (1 << (target + span + 1)) - 1, 1 << span, {}, []
    for i in np.argsort(sizes.astype(np.int64), kind="stable"):
        for sign, most in ((1, counts[i] - take[i]), (-1, take[i])):
            most = min(most, (target + span) // sizes[i])
            n = 1
            while most > 0:
                n = min(n, most)
                steps.append((i, sign * n, int(sign * n * sizes[i])))
                most, n = most - n, 2 * n
    for at, (_, _, step) in enumerate(steps):
        if reached >> target & 1:
            break
        front = (reached << step if step > 0 else reached >> -step) & mask & ~reached
        reached |= front
        while front:
            low = front & -front
            via[low.bit_length() - 1] = at
            front ^= low
    best = (reached & ((1 << (target + 1)) - 1)).bit_length() - 1
    while best != span:
        i, n, step = steps[via[best]]
        take[i] += n
        best -= step
    return take.astype(np.int64)


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")  # rows come in any order, and reruns must agree
    size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    wanted = int(round(target))
    passes = int(wanted >= size)
    take = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), wanted - passes * size)
    return pdf[["source", "size", "source_size", "target"]].assign(passes=passes, take=take)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0, 1 or 2) and taken (copies times size), a row per document.

    ``keys`` are columns of ``documents`` that tell its rows apart; they are carried along and settle ties. Without them,
    documents of one doc_id and length are told apart by their text.
    """
    named = list(keys) or ["_text_hash"]
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    docs = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed.alias("_hash"), *(keys or [F.xxhash64("text").alias("_text_hash")]))
    docs = materialize(docs.withColumn("_bin", F.pmod("_hash", F.lit(BINS)).cast("int")), "mix-docs")
    cells = materialize(docs.groupBy("source", "size", "_bin").agg(F.count("*").alias("n")), "mix-cells")
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aimed = targets(sources, weights, share)
    aimed = aimed.withColumnRenamed("source", "_source")
    filled = lengths.where("size > 0").join(aimed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    schema = "source string, size long, source_size long, target double, passes int, take long"
    quota = filled.groupBy("source").applyInPandas(_quota, schema)
    empty = lengths.where("size = 0").join(aimed, F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "source_size", "target", F.lit(0).alias("passes"), F.lit(0).cast("long").alias("take"))
    quota = quota.unionByName(empty).withColumnsRenamed({"source": "_q_source", "size": "_q_size"})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("size") == F.col("_q_size"))
    bins = cells.withColumn("_before", before).join(quota, same).select(
        F.col("source").alias("_b_source"), F.col("size").alias("_b_size"), F.col("_bin").alias("_b_bin"), "source_size", "target", "passes",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("_before"))).alias("_take"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "_bin").orderBy("_hash", "doc_id", *named))
    same = F.col("source").eqNullSafe(F.col("_b_source")) & (F.col("size") == F.col("_b_size")) & (F.col("_bin") == F.col("_b_bin"))
    joined = docs.withColumn("_rank", rank).join(bins, same)
    copies = (F.col("passes") + (F.col("_rank") <= F.col("_take")).cast("int")).cast("int")
    return joined.select("doc_id", *keys, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
