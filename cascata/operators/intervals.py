"""Interval and band operators on BIGINT times: unions of windows, containment, as-of state, history pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_intervals(df: DataFrame, keys: list[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Closed intervals of a key that overlap or touch become one; a null end is open. Adds ``n``, the number merged."""
    open_end = F.coalesce(F.col(end), F.lit((1 << 63) - 1))
    order = Window.partitionBy(*keys).orderBy(F.col(start), open_end)
    reach = F.max(open_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(open_end).alias("_end"), F.count("*").alias("n"))
    return merged.select(*keys, start, F.when(F.col("_end") < (1 << 63) - 1, F.col("_end")).alias(end), "n")


def merged_windows(df: DataFrame, keys: list[str], ts: str, width: int) -> DataFrame:
    """[t - width, t + width] around each distinct time of a key; windows that touch merge."""
    points = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t")).distinct()
    return union_intervals(points.select(*keys, (F.col("_t") - width).alias("start_ts"), (F.col("_t") + width).alias("end_ts")), keys).drop("n")


def in_windows(points: DataFrame, windows: DataFrame, keys: list[str], ts: str, bucket: int) -> DataFrame:
    """Points in a closed window of their key (left semi). Windows are spread over time buckets, so the join has an equi key."""
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ts") / bucket), F.floor(F.col("end_ts") / bucket))))
    side = spread.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_b", F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"))
    on = F.floor(F.col(ts) / bucket) == F.col("_b")
    for k in keys:
        on &= F.col(k) == F.col(f"_w_{k}")
    return points.join(side, on & F.col(ts).between(F.col("_s"), F.col("_e")), "left_semi")


def state_as_of(changes: DataFrame, queries: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """For each query (key, ts) the last state at or before it: one sort per key instead of a range join."""
    both = changes.select(key, ts, F.col(state).alias("_s"), F.lit(0).alias("_q")).unionByName(queries.select(key, ts, F.lit(None).cast(dict(changes.dtypes)[state]).alias("_s"), F.lit(1).alias("_q")))
    order = Window.partitionBy(key).orderBy(ts, "_q", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where("_q = 1").select(key, ts, F.col("_s").alias(state))


def sequence_events(df: DataFrame, group: list[str], *order: str) -> DataFrame:
    """Adds ``seq``, the place of an event within its group by ``order``."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def history_pairs(events: DataFrame, group: list[str], window: int, most: int, strict: bool = False, slack: int = 0) -> DataFrame:
    """(target, source) pairs of events of a group within ``window``; events: group, eid, ts, seq.

    strict=False, slack=0: the last ``most`` events by sequence, equal times included. strict=True: only earlier times count,
    and equal times don't use up places. slack > 0: sources up to ``slack`` later, too; the ``most`` nearest in time.
    The join has time buckets as equi keys, so that a task meets two windows of a group, never all of it.
    """
    width = max(1, window + slack)
    t = events.select(*group, F.col("eid").alias("t_eid"), F.col("ts").alias("t_ts"), F.col("seq").alias("t_seq"))
    s = events.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("eid").alias("s_eid"), F.col("ts").alias("s_ts"), F.col("seq").alias("s_seq"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t_ts") - window) / width), F.floor((F.col("t_ts") + slack) / width))))
    s = s.withColumn("_sb", F.floor(F.col("s_ts") / width))
    on = (F.col("_b") == F.col("_sb")) & F.col("s_ts").between(F.col("t_ts") - window, F.col("t_ts") + slack)
    for g in group:
        on &= F.col(g) == F.col(f"_{g}")
    if slack:
        on &= F.col("s_seq") != F.col("t_seq")
    else:
        on &= F.col("s_seq") < F.col("t_seq")
        on &= (F.col("s_ts") < F.col("t_ts")) if strict else (F.col("s_seq") >= F.col("t_seq") - most)
    pairs = t.join(s, on).select(*group, "t_eid", "t_ts", "s_eid", "s_ts", (F.col("t_ts") - F.col("s_ts")).alias("dt"), "t_seq", "s_seq")
    if slack or strict:
        near = Window.partitionBy("t_eid").orderBy(F.abs("dt"), F.desc("s_seq"))
        pairs = pairs.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).drop("_r")
    return pairs


def bulk_windows(df: DataFrame, ts: str, width: int, least: int) -> DataFrame:
    """Adds ``bulk``: whether the row's fixed time bucket holds ``least`` rows or more. Counts combine before they join."""
    bucket = F.floor(F.col(ts) / width)
    counts = df.groupBy(bucket.alias("_bk")).agg(F.count("*").alias("_n"))
    return df.join(counts, bucket == F.col("_bk")).withColumn("bulk", F.col("_n") >= least).drop("_bk", "_n")


def running_states(events: DataFrame, device: str, kinds: list[str], *order: str) -> DataFrame:
    """State of a device before each of its events: how many alarms of each kind are up. Clears never go below zero.

    The clamp makes a running sum wrong; a running sum minus its running minimum (at most zero) is right.
    """
    w = Window.partitionBy(device).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    out = events
    for kind in kinds:
        step = F.when(F.col("kind") == kind, F.when(F.col("is_clear"), -1).otherwise(1)).otherwise(0)
        out = out.withColumn(f"_sum_{kind}", F.sum(step).over(upto))
    for kind in kinds:
        total = F.coalesce(F.lag(f"_sum_{kind}").over(w), F.lit(0))
        low = F.least(F.lit(0), F.coalesce(F.min(f"_sum_{kind}").over(before), F.lit(0)))
        out = out.withColumn(f"{kind}_up", (total - low).cast("long"))
    return out.drop(*[f"_sum_{k}" for k in kinds])


def sessions(df: DataFrame, keys: list[str], ts: str, gap: int, strict: bool) -> DataFrame:
    """Adds ``session``: a new one starts when the pause exceeds the gap (strict), or reaches it (not strict)."""
    w = Window.partitionBy(*keys).orderBy(ts, "eid")
    pause = F.col(ts) - F.lag(ts).over(w)
    new = F.when(pause.isNull() | ((pause > gap) if strict else (pause >= gap)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sliding_windows(df: DataFrame, ts: str, size: int, step: int) -> DataFrame:
    """Each row once per window [start, start + size) that holds it; starts are multiples of ``step``."""
    first = (F.floor((F.col(ts) - size) / step) + 1) * step
    return df.withColumn("window_start", F.explode(F.sequence(first, F.floor(F.col(ts) / step) * step, F.lit(step).cast("long"))))




def with_next(windows: DataFrame, points: DataFrame, keys: list[str], start: str, ts: str, bucket: int) -> DataFrame:
    """``windows`` with ``next_ts``: the key's earliest point at or after ``start``, if any. Rows with a null key or start are left out.

    A sort within each key and time bucket, where the first point of the next filled bucket stands in for all later ones, so
    that the work does not grow with windows times points, and a hot key is dealt by its buckets.
    """
    there = lambda df, t: df.where(F.concat(*[F.col(k).isNotNull().cast("string") for k in keys]) == "true" * len(keys)).where(F.col(t).isNotNull()).withColumn("_b", F.floor(F.col(t) / bucket))
    w, p = there(windows, start), there(points.select(*keys, F.col(ts).alias("_t")), "_t")
    none = F.lit(None).cast(w.select(F.struct(*windows.columns)).schema[0].dataType)
    firsts = p.groupBy(*keys, "_b").agg(F.min("_t").alias("_t")).unionByName(w.select(*keys, "_b", F.lit(None).cast("long").alias("_t")).distinct()).groupBy(*keys, "_b").agg(F.min("_t").alias("_t"))
    later = firsts.withColumn("_t", F.last("_t", True).over(Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))).where("_t is not null")
    marks = p.unionByName(later).select(*keys, "_b", "_t", F.col("_t").alias("_p"), none.alias("_w"))
    both = marks.unionByName(w.select(*keys, "_b", F.col(start).alias("_t"), F.lit(None).cast("long").alias("_p"), F.struct(*windows.columns).alias("_w")))
    order = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.col("_p").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("next_ts", F.last("_p", True).over(order)).where("_w is not null").select("_w.*", "next_ts")
