"""Stream hygiene: reordering, late events, duplicates, flapping and orphan clears.

The batch form orders all events once and runs the per-key machine over each key; whether an event is late depends on the
whole stream's progress, which a running maximum over arrival order gives. The streaming form keeps one key's state in
``transformWithStateInPandas`` and relies on the watermark for lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Policy:
    reorder_s: float = 2.0
    late_s: float = 0.0
    duplicate_s: float = 120.0
    flap_s: float = 300.0
    orphan_clears: bool = False


class KeyMachine:
    """One key's state: last clear, last raise, whether it is active."""

    def __init__(self, policy: Policy, last_clear: float | None = None, last_raise: float | None = None, active: bool = False):
        self.policy, self.last_clear, self.last_raise, self.active = policy, last_clear, last_raise, active

    def take(self, ts: float, is_clear: bool) -> str:
        if is_clear:
            was, self.last_clear, self.active = self.active, ts, False
            return "clear" if was or self.policy.orphan_clears else "skip:orphan_clear"
        if self.last_clear is not None and 0 <= ts - self.last_clear <= self.policy.flap_s:
            self.last_raise = ts
            return "skip:flap_reopen_compressed"
        if self.active and self.last_raise is not None and 0 <= ts - self.last_raise <= self.policy.duplicate_s:
            self.last_raise = ts
            return "skip:duplicate_raise_compressed"
        self.last_raise, self.active = ts, True
        return "raise"


def sanitize(events: DataFrame, keys: list[str], policy: Policy, arrival: str = "arrival") -> DataFrame:
    """``events`` (keys, event_id, ts, is_clear, arrival) with ``action``.

    An event is released once a later arrival has moved the watermark past it; it is late if what was released before its
    arrival is newer than its time plus the tolerance. Released events are taken in order of time, then arrival.
    """
    seen = F.max("ts").over(Window.partitionBy("_shard").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    # The watermark is global. Arrivals are cut into shards whose starting maxima are carried over, so no task sees all rows.
    size = 100_000
    sharded = events.withColumn("_shard", F.floor(F.col(arrival) / size))
    tops = sharded.groupBy("_shard").agg(F.max("ts").alias("_top"))
    start = tops.withColumn("_start", F.max("_top").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))).select("_shard", "_start")
    marked = sharded.withColumn("_seen", seen).join(start, "_shard").withColumn("_mark", F.greatest("_seen", "_start") - policy.reorder_s)
    late = F.col("ts") + policy.late_s < F.col("_mark")
    marked = marked.withColumn("_late", F.coalesce(late, F.lit(False))).drop("_shard", "_seen", "_start", "_mark")
    columns = [c for c in events.columns]

    def machine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", arrival], kind="stable")
        state = KeyMachine(policy)
        pdf["action"] = ["skip:late_after_reorder_watermark" if is_late else state.take(float(t), bool(c)) for t, c, is_late in zip(pdf["ts"], pdf["is_clear"], pdf["_late"])]
        return pdf[[*columns, "action"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", action string"
    return marked.groupBy(*keys).applyInPandas(machine, schema)


class HygieneProcessor(StatefulProcessor):
    """The key machine as a streaming operator; rows of a batch are taken in order of time."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last_clear double, last_raise double, active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None, False)
        machine = KeyMachine(self.policy, held[0], held[1], bool(held[2]))
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        pdf["action"] = [machine.take(float(t), bool(c)) for t, c in zip(pdf["ts"], pdf["is_clear"])]
        self.state.update((machine.last_clear, machine.last_raise, machine.active))
        yield pdf[["key", "event_id", "ts", "is_clear", "action"]]

    def close(self) -> None:
        pass


HYGIENE_SCHEMA = "key string, event_id string, ts double, is_clear boolean, action string"


def sanitize_stream(events: DataFrame, policy: Policy) -> DataFrame:
    """Streaming twin for key, event_id, ts (seconds), is_clear."""
    return events.groupBy("key").transformWithStateInPandas(HygieneProcessor(policy), HYGIENE_SCHEMA, "Append", "None")


def pending_maturity(triggers: DataFrame, keys: list[str], wait: int, watermark: DataFrame | None = None) -> DataFrame:
    """(keys, first_ts, ready_ts, last_ts, n): pending evaluations in batch form.

    The first trigger of a key opens a pending entry that matures ``wait`` later; later triggers before that join it, the next
    one after it opens anew. Entries whose time has not come by the newest event stay out, unless no ``watermark`` is given.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, first, last, n = [], None, None, 0
        for ts in sorted(pdf["ts"]):
            if first is not None and ts >= first + wait:
                out.append((first, first + wait, last, n))
                first = None
            if first is None:
                first, n = ts, 0
            last, n = ts, n + 1
        out.append((first, first + wait, last, n))
        found = pd.DataFrame(out, columns=["first_ts", "ready_ts", "last_ts", "n"])
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found

    types = dict(triggers.dtypes)
    schema = "first_ts long, ready_ts long, last_ts long, n long, " + ", ".join(f"{k} {types[k]}" for k in keys)
    entries = triggers.select(*keys, "ts").groupBy(*keys).applyInPandas(run, schema)
    if watermark is None:
        return entries
    return entries.crossJoin(F.broadcast(watermark.agg(F.max("ts").alias("_w")))).where("ready_ts <= _w").drop("_w")


def without_cleared(raises: DataFrame, clears: DataFrame, identity: list[str]) -> DataFrame:
    """Raises whose exact occurrence was not cleared at or before their evaluation time (eval_ts)."""
    c = clears.select(*[F.col(k).alias(f"_c_{k}") for k in identity], F.col("clear_ts").alias("_ct"))
    on = F.col("_ct") <= F.col("eval_ts")
    for k in identity:
        on &= F.col(k) == F.col(f"_c_{k}")
    return raises.join(c, on, "left_anti")


def unexpired(events: DataFrame, now: int, age: int, power_age: int) -> DataFrame:
    """Strictly older than their limit go; power alarms live longer."""
    return events.where(now - F.col("ts") <= F.when(F.col("kind") == "power", power_age).otherwise(age))
