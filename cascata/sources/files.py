"""File sources and sinks. Every reader takes paths that Spark can open; nothing is read on the driver."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_VERSION = 3
#: Raw field names and what we call them.
FIELDS = {
    "告警标题": "alarm_title", "告警源": "alarm_source", "站点ID": "site_id", "告警编码ID": "eid", "告警首次发生时间": "first_time", "告警清除时间": "clear_time",
    "清除告警": "is_clear", "工单号": "ticket_id", "故障组ID": "native_group_id", "物理端口名称": "port_name",
}
ALIASES = {"eid": ("eid", "alarm_id", "告警编码ID", "event_id")}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped and a malformed line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("value").alias("raw"))
    return parsed.select("r.*", "raw")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header row; a byte-order mark goes, and rows without any filled cell do."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    filled = F.lit(False)
    for c in rows.columns:
        filled |= F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != ""
    return rows.where(filled)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("row", pa.int64()), ("record", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                for name in sorted(archive.namelist()):
                    kind = name.rsplit(".", 1)[-1].lower()
                    if kind not in ("csv", "jsonl"):
                        continue
                    text = io.TextIOWrapper(archive.open(name), "utf-8-sig", newline="")
                    source = csv.DictReader(text) if kind == "csv" else (json.loads(x) for x in text if x.strip())
                    block: list[tuple] = []
                    for i, record in enumerate(source):
                        if any(str(v).strip() for v in record.values() if v is not None):
                            block.append((path.as_py(), name, i, json.dumps(record, ensure_ascii=False)))
                        if len(block) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)
                            block = []
                    if block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


def read_zip(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV and JSONL members in name order, parsed into ``schema``; a task holds one archive, rows stream out of it."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_members, "path string, member string, row long, record string")
    return rows.select("path", "member", "row", F.from_json("record", schema).alias("r"), F.col("record").alias("raw")).select("r.*", "path", "member", "row", "raw")


def read_alarms(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All alarm files below a path, each by its extension; others are skipped. Keeps the file name, which orders files."""
    parts = []
    names = [c.name for c in schema]
    for glob, reader in (("*.jsonl", "json"), ("*.csv", "csv"), ("*.zip", "zip")):
        probe = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
        if probe.isEmpty():
            continue
        if reader == "json":
            df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).schema(schema).option("mode", "FAILFAST").json(path)
            df = df.select(*names, F.col("_metadata.file_name").alias("source_file"))
        elif reader == "csv":
            df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("header", True).csv(path)
            file = F.col("_metadata.file_name").alias("source_file")
            held = {c.removeprefix("﻿"): c for c in df.columns}
            df = df.select(*[(F.col(f"`{held[f.name]}`") if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], file)
        else:
            files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
            rows = files.mapInArrow(_members, "path string, member string, row long, record string")
            df = rows.select(F.from_json("record", schema).alias("r"), F.concat_ws("!", F.element_at(F.split("path", "/"), -1), "member").alias("source_file")).select("r.*", "source_file")
        parts.append(df)
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("source_file", T.StringType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def renamed(df: DataFrame) -> DataFrame:
    """Raw field names to ours; of several names for one field the first filled one counts."""
    out = df
    for name, options in ALIASES.items():
        held = [F.when(F.trim(F.col(o).cast("string")) != "", F.col(o).cast("string")) for o in options if o in df.columns]
        if held:
            out = out.withColumn(name, F.coalesce(*held))
    return out.withColumnsRenamed({raw: ours for raw, ours in FIELDS.items() if raw in out.columns and ours not in out.columns})


def write_sorted_cache(events: DataFrame, path: str, options: dict) -> None:
    """Events as Parquet sorted by time, with a small table beside them that states version and options."""
    events.repartitionByRange("ts").sortWithinPartitions("ts", "eid").write.mode("overwrite").parquet(f"{path}/events")
    spark = events.sparkSession
    spark.createDataFrame([(CACHE_VERSION, json.dumps(options, sort_keys=True))], "version int, options string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_sorted_cache(spark: SparkSession, path: str, options: dict | None = None) -> tuple[DataFrame, list[str]]:
    """(events, names of options that differ from those the cache was built with); other versions are refused."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != CACHE_VERSION:
        raise ValueError(f"cache version {meta['version']} where {CACHE_VERSION} is needed")
    built = json.loads(meta["options"])
    differs = sorted(k for k in {*built, *(options or {})} if built.get(k) != (options or {}).get(k)) if options is not None else []
    return spark.read.parquet(f"{path}/events"), differs


def write_resources(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_resources(spark: SparkSession, path: str, wanted: list[str]) -> dict[str, DataFrame]:
    """Only the wanted tables are opened."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in wanted}


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def write_model(model: dict[str, DataFrame], config: dict, path: str) -> None:
    """Parameter tables as Parquet, and the fingerprint of the configuration they belong to."""
    write_resources(model, path)
    next(iter(model.values())).sparkSession.createDataFrame([(fingerprint(config), json.dumps(config, sort_keys=True, default=str))], "fingerprint string, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_config")


def read_model(spark: SparkSession, path: str, tables: list[str], config: dict | None = None) -> dict[str, DataFrame]:
    held = spark.read.parquet(f"{path}/_config").first()
    if config is not None and held["fingerprint"] != fingerprint(config):
        raise ValueError("the stored model belongs to another configuration")
    return read_resources(spark, path, tables)


def write_groups(groups: DataFrame, path: str) -> None:
    """One JSON object per group and line."""
    groups.write.mode("append").json(path)


def split_rules(rules: DataFrame) -> DataFrame:
    """Rule rows (rule, left_alarm, right_alarm, minutes, link_type) with '|' lists, one row per pair of upper-cased titles."""
    titles = lambda c: F.filter(F.transform(F.split(F.upper(F.col(c)), "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    left = rules.withColumn("left_alarm", F.explode(titles("left_alarm")))
    return left.withColumn("right_alarm", F.explode(titles("right_alarm")))


def graph_sites(site_graph: DataFrame) -> DataFrame:
    """All sites of a graph (site, links map): its keys and the keys of its links."""
    keys = site_graph.select("site")
    return keys.union(site_graph.select(F.explode(F.map_keys("links")))).where("trim(site) <> ''").distinct()


def row_counts(spark: SparkSession, path: str, glob: str, header_rows: int = 0) -> DataFrame:
    """(file, rows) of text files, without their header rows."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return lines.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.greatest(F.lit(0), F.count("*") - header_rows).alias("rows"))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.text(path).limit(n)
