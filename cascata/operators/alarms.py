"""Alarm ingest: whitelist, site resolution, raise and clear events, ordering, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.functions.scalars import delayed_clear, is_true_text, parse_list, parse_time
from cascata.operators.ranking import running_totals


def resolve_site(alarms: DataFrame, ne_site: DataFrame, valid_sites: DataFrame | None = None) -> DataFrame:
    """Own site_id, else the element's. With ``valid_sites`` an own site that isn't valid falls back too."""
    own = F.when(F.trim(F.coalesce("site_id", F.lit(""))) != "", F.trim("site_id"))
    dim = ne_site.select(F.col("ne_id").alias("_ne"), F.col("site_id").alias("_ne_site"))
    joined = alarms.join(dim, F.trim("alarm_source") == F.col("_ne"), "left")
    if valid_sites is None:
        return joined.withColumn("site_id", F.coalesce(own, "_ne_site")).drop("_ne", "_ne_site")
    valid = valid_sites.select(F.col("site_id").alias("_valid")).distinct()
    first = joined.withColumn("_own", own).join(valid, F.col("_own") == F.col("_valid"), "left")
    resolved = first.withColumn("site_id", F.when(F.col("_valid").isNotNull(), F.col("_own")).otherwise(F.col("_ne_site"))).drop("_ne", "_ne_site", "_own", "_valid")
    return resolved.join(valid.withColumnRenamed("_valid", "site_id"), "site_id", "left_semi")


def normalize(raw: DataFrame, titles: list[str], ne_site: DataFrame, valid_sites: DataFrame, start_us: int | None = None, end_us: int | None = None, clear_delay_s: float = 0.0, sources: DataFrame | None = None) -> DataFrame:
    """Raise and clear events (eid, alarm_source, site_id, alarm_title, ts, is_clear) of the raw alarms that pass.

    raw: eid, alarm_title, alarm_source, site_id, first_time, clear_time as text. The order of checks is title, region
    allow-list on the source, site, then the inclusive range of first times.
    """
    rows = raw.where(F.col("alarm_title").isin(*titles)).withColumn("alarm_source", F.trim(F.coalesce("alarm_source", F.lit(""))))
    if sources is not None:
        rows = rows.join(sources.select("alarm_source").distinct(), "alarm_source", "left_semi")
    rows = resolve_site(rows, ne_site, valid_sites)
    rows = rows.withColumn("_first", F.unix_micros(parse_time(F.col("first_time")))).withColumn("_clear", F.unix_micros(parse_time(F.col("clear_time"))))
    if start_us is not None:
        rows = rows.where(F.col("_first") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("_first") <= end_us)
    both = F.array(
        F.struct(F.col("_first").alias("ts"), F.lit(False).alias("is_clear")),
        F.struct(F.when(F.col("_clear").isNotNull(), delayed_clear(F.col("_first"), F.col("_clear"), clear_delay_s)).alias("ts"), F.lit(True).alias("is_clear")),
    )
    events = rows.select("eid", "alarm_source", "site_id", "alarm_title", F.explode(both).alias("e"))
    return events.where("e.ts is not null").select("eid", "alarm_source", "site_id", "alarm_title", "e.ts", "e.is_clear")


def time_sorted(events: DataFrame, *tie: str) -> DataFrame:
    """Sorted by time only; what came first in the input breaks ties, a raise before its clear."""
    return events.orderBy("ts", *tie)


def trim_trailing_clears(events: DataFrame) -> DataFrame:
    """Without the clears after the last raise; (ts, eid, is_clear) orders events. Empty if nothing was raised."""
    last = events.where(~F.col("is_clear")).agg(F.max(F.struct("ts", "eid", "is_clear")).alias("_last"))
    return events.join(F.broadcast(last), F.struct("ts", "eid", "is_clear") <= F.col("_last"), "inner").drop("_last")


def event_classes(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(~F.col("is_clear")).alias("raises"), F.count_if("is_clear").alias("clears"))


def clear_flag(column: str) -> Column:
    return is_true_text(F.col(column))


def latest_wins(records: DataFrame, keys: list[str], modified: Column, *tie: Column) -> DataFrame:
    """One row per key, the most recently modified; among equals the first by ``tie``. Rows with a null key all stay.

    An aggregation with map-side combine instead of a window: hot keys don't gather in one task.
    """
    keyless = records.where(" or ".join(f"`{k}` is null" for k in keys))
    keyed = records.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in records.columns if c not in keys]
    # max_by takes the largest order; ties are negated so that the first wins.
    order = F.struct(modified.alias("m"), *[(-t).alias(f"t{i}") for i, t in enumerate(tie)])
    best = keyed.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")
    return best.unionByName(keyless.select(*best.columns))


def duplicate_audit(records: DataFrame, key: str, *content: str) -> DataFrame:
    """Keys that occur more than once, with their count and number of different contents."""
    mark = F.sha2(F.to_json(F.struct(*content)).cast("binary"), 256)
    return records.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(mark).alias("variants")).where("n > 1")


def merge_occurrences(records: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """One row per occurrence; delimited text columns become the ordered distinct union of their parts."""
    def united(c: str) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_order", F.col(c).alias("v")))), lambda x: x["v"])
        return F.array_distinct(F.flatten(F.transform(ordered, lambda v: parse_list(v)))).alias(c)

    return records.groupBy(*keys).agg(*[united(c) for c in lists], F.count("*").alias("records"))


def field_coverage(records: DataFrame) -> DataFrame:
    """(field, present, filled): in how many records a column is not null, and not blank."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in records.columns])
    rows = records.select(F.explode(cells).alias("c"))
    return rows.groupBy(F.col("c.field").alias("field")).agg(F.count("c.v").alias("present"), F.count_if(F.trim("c.v") != "").alias("filled"))


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def split_by_time(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """Adds ``part``: the last ``fraction`` of rows by time is 'val'; ``order`` tells rows apart.

    The cutting row comes from running counts over ranges of the order, so that no task ranks all rows.
    """
    n = df.count()
    last = int(n * fraction)
    if not last:
        return df.withColumn("part", F.lit("train"))
    ranked = running_totals(df.select(*order), [F.col(c) for c in order], {"_n": F.lit(1)}, "split")
    cut = ranked.where(F.col("_n") == n - last + 1).select(F.struct(*order).alias("_cut"))  # one row
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.struct(*order) >= F.col("_cut"), "val").otherwise("train")).drop("_cut")
