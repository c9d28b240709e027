"""Totals over all rows in one order, without a window that gathers them: ranges of the order, and their offsets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascata.session import materialize


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], label: str = "running") -> DataFrame:
    """``df`` with, for each name in ``totals``, the sum of its Column over this row and all rows before it.

    Rows are dealt to ranges of ``order`` (which should tell rows apart), each range is summed by itself, and the ranges
    before a row's own add their totals. The driver sees a row for each range. Equal order keys share a range, so callers
    with few distinct keys aggregate by key first.
    """
    spark = df.sparkSession
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    sums = dealt.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in totals.items()]).orderBy("_range")
    rows = sums.collect()  # at most spark.sql.shuffle.partitions
    before = [[0, *accumulate(r[n] or 0 for r in rows)][:-1] for n in totals]
    names = [f"_before_{n}" for n in totals]
    types = dict(sums.dtypes)
    schema = ", ".join(["_range int", *[f"`_before_{n}` {types[n]}" for n in totals]])
    offsets = spark.createDataFrame([(r["_range"], *[type(r[n] or 0)(x) for n, x in zip(totals, at)]) for r, at in zip(rows, zip(*before))], schema)
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({n: F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in totals.items()})
    found = summed.join(F.broadcast(offsets), "_range")
    return found.withColumns({n: F.col(n) + F.col(b) for n, b in zip(totals, names)}).drop("_range", *names)
