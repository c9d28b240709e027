"""Benchmark decontamination with DataFrame operations only.

The normalised word windows of the benchmark form a set of 64-bit hashes. Every window of every document is hashed,
looked up in that set, and a hit is verified by comparing its words. Below the broadcast bound, the lookup is a
broadcast hash join inside the scan stage, so that nothing but hits is shuffled; beyond it, hashes are joined by a
shuffle and the hits go back to their documents for verification.

Null text has no words. Rows that repeat a doc_id are separate documents and give a row each. Columns other than those
named are ignored (``decontaminate`` passes them through). Benchmark rows with a null item_id contaminate but are not
counted as items. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascata.llm.common import attach, fits_broadcast, fresh, normal_words
from cascata.session import materialize

WINDOW = 10
_MARK = -7046029254386353131  # stands before the windows of each document, so that documents without hits keep a row


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w_hash, w_words, item_id): every run of ``window`` words of each item; shorter items are one window."""
    words = benchmark.select(F.col("item_id"), normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("w_words"))
    return each.select(F.xxhash64("w_words").alias("w_hash"), "w_words", "item_id").distinct()


def _hashes(length: int) -> Column:
    n = F.size("words")
    starts = F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, length)))


def _position(lengths: list[int]) -> tuple[Column, Column]:
    """From the place in the concatenated hash lists to the first word (from 1) and the window's length."""
    offset, start, size = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
    for length in lengths:
        count = F.greatest(F.size("words") - length + 1, F.lit(0))
        here = (F.col("at") > offset) & (F.col("at") <= offset + count)
        start, size = F.when(here, F.col("at") - offset).otherwise(start), F.when(here, F.lit(length)).otherwise(size)
        offset = offset + count
    return start, size


def _covered(spans: Column) -> Column:
    """Number of words under a list of (start, end) spans, end exclusive."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = F.aggregate(
        F.array_sort(spans),
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
    )
    return step["n"].cast("long")


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: row_key, doc_id, text_key (a hash of its text), n_words, the hit spans (start, end) of words from 0, and the items that occur."""
    known = benchmark_windows(benchmark, window)
    lengths = sorted(r[0] for r in known.select(F.size("w_words")).distinct().collect())  # at most ``window`` values
    docs = documents.select(
        F.monotonically_increasing_id().alias("row_key"), F.col("doc_id"), F.xxhash64("text").alias("text_key"), normal_words(F.col("text")).alias("words")
    )
    if not lengths:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return docs.select("row_key", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    mark = known.sparkSession.range(1).select(
        F.lit(_MARK).cast("long").alias("w_hash"), F.array().cast("array<string>").alias("w_words"), F.lit(None).cast(dict(known.dtypes)["item_id"]).alias("item_id")
    )
    known = known.unionByName(mark)
    listed = docs.select("row_key", "doc_id", "text_key", "words", F.concat(F.array(F.lit(_MARK).cast("long")), *[_hashes(n) for n in lengths]).alias("hashes"))
    small = fits_broadcast(known, F.octet_length(F.to_json("w_words")) + 64)
    if small:
        found = listed.select("row_key", "doc_id", "text_key", "words", F.posexplode("hashes").alias("at", "w_hash")).join(F.broadcast(known), "w_hash")
    else:
        keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), normal_words(F.col("text")).alias("words"))
        keyed = keyed.groupBy("doc_id", "text_key").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
        at = keyed.select("doc_id", "text_key", F.posexplode(F.concat(F.array(F.lit(_MARK).cast("long")), *[_hashes(n) for n in lengths])).alias("at", "w_hash"))
        marks = at.where("at = 0").select("doc_id", "text_key", "at", F.array().cast("array<string>").alias("w_words"), F.lit(None).cast(dict(known.dtypes)["item_id"]).alias("item_id"))
        at = marks.unionByName(at.where("at > 0").join(known, "w_hash").select("doc_id", "text_key", "at", "w_words", "item_id"))
        same = (F.col("a.doc_id").eqNullSafe(F.col("k.doc_id"))) & (F.col("a.text_key").eqNullSafe(F.col("k.text_key")))
        found = at.alias("a").join(keyed.alias("k"), same).select(
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("row_key"), F.col("k.doc_id").alias("doc_id"), F.col("k.text_key").alias("text_key"), "words", "at", "w_words", "item_id"
        )
    start, size = _position(lengths)
    found = found.select("row_key", "doc_id", "text_key", "words", "at", "w_words", "item_id", start.alias("start"), size.alias("size"))
    true_hit = (F.col("at") == 0) | F.slice("words", F.coalesce("start", F.lit(1)), F.coalesce("size", F.lit(0))).eqNullSafe(F.col("w_words"))
    span = F.when(F.col("at") > 0, F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("size")).alias("end")))
    return (
        found.where(true_hit)
        .select("row_key", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), span.alias("span"), F.col("item_id").cast("string").alias("item"))
        .groupBy("row_key", "doc_id", "text_key")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
    )


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items and a digest of the items."""
    found = hits(documents, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", cleaned: str = "clean_text") -> DataFrame:
    """``documents`` without what occurs in the benchmark.

    remove="documents" drops every row whose own text has a hit. remove="spans" keeps all rows and cuts the hit words out of the
    normalised text, which it adds as ``cleaned``. Rows are matched by doc_id and text, so repeated rows share a fate.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    found = hits(documents.select("doc_id", "text"), benchmark, window).where(F.size("spans") > 0)
    bad_id, bad_key, spans_of = fresh(documents, "_bad_id", "_bad_key", "_spans")
    if remove == "documents":
        bad = materialize(found.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "decontam-bad")
        return attach(documents, bad, "doc_id", bad_id, "left_anti", null_safe=True, also=F.xxhash64("text") == F.col(bad_key))
    spans = found.groupBy(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).agg(F.first("spans").alias(spans_of))
    joined = documents.join(spans, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key)), "left")
    words = normal_words(F.col("text"))
    kept = F.filter(F.transform(words, lambda w, i: F.when(F.exists(spans_of, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit(None)).otherwise(w)), lambda w: w.isNotNull())
    return joined.withColumn(cleaned, F.array_join(kept, " ")).drop(bad_id, bad_key, spans_of)
