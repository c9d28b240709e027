"""A corpus pipeline over ``documents``: each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.llm import decontam, langid, line_dedup, mixing, ngram_join
from cascata.llm.common import BLANK_WORD, attach, fresh, with_row_key
from cascata.session import materialize, table

#: Below this calibrated probability no language stands out, and the document is rejected.
LEAST_SCORE = 0.3


def columns(docs: DataFrame) -> list[str]:
    """The columns of ``docs``, quoted."""
    return [f"`{c}`" for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled rows; documents without letters or without a likely language go."""
    label, score = fresh(docs, "_label", "_label_score")
    named = langid.annotate(docs, langid.fit(docs), docs.columns, (label, score))
    return named.where((F.col(label) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*columns(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many documents of a source go; n_chars follows the text."""
    (dropped,) = fresh(docs, "_lines_dropped")
    out = line_dedup.drop_boilerplate(docs, host="source", dropped=dropped)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*columns(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (null last), among equal ones that of the smallest key.

    A row's key is a hash of doc_id and text: doc_ids may be null or repeat. Texts without words are nobody's copies.
    """
    key, other = fresh(docs, "_key", "_other")
    once = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    worded = once.where(F.regexp_like("text", F.lit(BLANK_WORD)))
    repeated = materialize(worded.groupBy(key).count().where("count > 1").select(F.col(key).alias(other)), "pipeline-repeated")
    if not repeated.isEmpty():
        one = materialize(attach(once, repeated, key, other, "left_semi").dropDuplicates([key]), "pipeline-one")
        once = attach(once, repeated, key, other, "left_anti").unionByName(one)
    linked = materialize(ngram_join.link_documents(once.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0"), "pipeline-linked")
    named = linked.select(F.col("doc_id").alias("key"), "component_id").join(once.select(F.col(key).alias("key"), "doc_id"), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first"))
    others = linked.select(F.col("doc_id").alias(other)).join(first.select(F.col("first.key").alias(other)), other, "left_anti")
    return attach(once, materialize(others, "pipeline-others"), key, other, "left_anti").select(*columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a word window of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy that the mix takes, with the document's columns and its source's target.

    The added columns are size, source_size, target and copy, with an underscore before those that ``docs`` has already.
    """
    keyed, keys = with_row_key(docs)
    numbers = fresh(keyed, "size", "source_size", "target", "copy")
    times, *ends = fresh(keyed, "_copies", *[f"_of{k}" for k in keys])
    mixed = mixing.mix(keyed, keys=keys).where("copies > 0")
    mixed = materialize(mixed.select(*[F.col(k).alias(e) for k, e in zip(keys, ends)], *[F.col(c).alias(n) for c, n in zip(("size", "source_size", "target"), numbers)], F.col("copies").alias(times)), "pipeline-mix")
    joined = attach(keyed, mixed, keys[1], ends[1], "inner", also=F.col(keys[0]) == F.col(ends[0]))
    return joined.select(*columns(docs), *numbers[:3], F.explode(F.sequence(F.lit(1), F.col(times))).alias(numbers[3]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
]

#: Language identification trains a model, which SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
