"""Line dedup by site-relative frequency, with DataFrame operations only.

For each host, the number of its pages that hold a line is divided by the number of its pages. Lines above a boilerplate
ratio are dropped from every page of that host, if at least ``min_pages`` of its pages hold them (5 by default): on a host of
fewer than 1 / ratio pages every line of every page is above the ratio, and a pair of copies would lose all its text. So a
host of fewer pages than that loses no line, and one of more than min_pages / ratio (100) pages follows the ratio alone, as
every host does with ``min_pages=1``. Each page counts a line once, and counting combines before the shuffle,
so a hot host costs no more than others. A host has at most (lines per page / ratio) such lines, whatever its size.

Lines are compared by the MD5 of what is left without the blanks around them, which keeps the shuffle narrow; blank lines are neither counted nor dropped. Pages with a null host
form a host of their own. Null text stays null and counts as a page without lines; a page that loses every line keeps
its row with empty text. Repeated rows are pages like any other. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.llm.common import BROADCAST_BYTES, fresh
from cascata.session import materialize

RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_md5, pages, host_pages): lines on more than ``ratio`` of a host's pages, on ``min_pages`` at least."""
    filled = F.filter(F.transform(_lines(F.col(text)), _trimmed), lambda x: x != "")
    rows = pages.select(F.col(host).alias("_host"), F.explode(F.array_distinct(F.transform(filled, _key))).alias("_line"))
    often = rows.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("_h")).agg(F.count("*").alias("_total"))
    return (
        often.join(totals, F.col("_host").eqNullSafe(F.col("_h")))
        .where(F.col("_n") > F.lit(ratio) * F.col("_total"))
        .select(F.col("_host").alias("host"), F.col("_line").alias("line_md5"), F.col("_n").alias("pages"), F.col("_total").alias("host_pages"))
    )


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str = "lines_dropped") -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``; adds the number of lines dropped as ``dropped``."""
    found = boilerplate(pages, host, text, ratio, min_pages)
    bp_host, bp, kept_lines = fresh(pages, "_bp_host", "_bp", "_kept")
    per_host = found.groupBy(F.col("host").alias(bp_host)).agg(F.collect_set("line_md5").alias(bp), F.sum(F.lit(64)).alias("_bytes"))
    per_host = materialize(per_host, "lines-boilerplate")
    size = per_host.agg(F.sum("_bytes")).first()[0] or 0  # measured before anything is broadcast
    side = F.broadcast(per_host.drop("_bytes")) if size <= BROADCAST_BYTES else per_host.drop("_bytes")
    joined = pages.join(side, F.col(host).eqNullSafe(F.col(bp_host)), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bp), _key(_trimmed(x))))
    untouched = F.col(bp).isNull() | F.col(text).isNull()
    return (
        joined.withColumn(kept_lines, F.when(~untouched, kept))
        .withColumn(dropped, F.when(untouched, F.lit(0)).otherwise(F.size(lines) - F.size(kept_lines)).cast("long"))
        .withColumn(text, F.when(untouched, F.col(text)).otherwise(F.array_join(kept_lines, "\n")))
        .drop(bp_host, bp, kept_lines)
    )
