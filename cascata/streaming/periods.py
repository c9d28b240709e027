"""Alarm periods: batch islands, and the same state machine for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_periods(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, start_ts, latest_ts, end_ts, raises, cleared): one row per period; events: keys, eid, ts, is_clear.

    A period ends with a clear, or after ``gap`` without a raise (reaching the gap ends it: end_ts is the deadline). Clears
    without an open period give nothing. An end that no event has shown yet is null.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "eid")
    pause = F.col("ts") - F.lag("ts").over(w)
    new = F.when(pause.isNull() | (pause >= gap) | F.lag("is_clear").over(w), 1).otherwise(0)
    marked = events.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("ts").over(w))
    raised = ~F.col("is_clear")
    out = marked.groupBy(*keys, "_island").agg(
        F.min(F.when(raised, F.col("ts"))).alias("start_ts"), F.max(F.when(raised, F.col("ts"))).alias("latest_ts"), F.max(F.when(F.col("is_clear"), F.col("ts"))).alias("_clear"),
        F.count_if(raised).alias("raises"), F.max("is_clear").alias("cleared"), F.max(F.col("_next").isNotNull()).alias("_more"), F.sort_array(F.collect_list(F.when(raised, F.col("eid")))).alias("eids"),
    ).where("raises > 0")
    end = F.when(F.col("cleared"), F.col("_clear")).when(F.col("_more"), F.col("latest_ts") + gap)
    return out.select(*keys, "start_ts", "latest_ts", end.alias("end_ts"), "raises", "cleared", "eids")
