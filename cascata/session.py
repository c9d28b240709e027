"""Session, table and scratch helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "cascata", **extra: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def visible_to_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, also when only the driver's sys.path names that folder."""
    root = str(Path(__file__).resolve().parents[1])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, held) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read only through Spark so that any store works."""
    visible_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a local temporary folder is made and recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("cascata.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cascata-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("cascata.scratch", base)
    return base.rstrip("/")


_passing: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    visible_to_workers(spark)
    path = f"{scratch(spark)}/cascata/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within this block, written tables last until its end, but for those that the yielded function is given at once.

    ``kept = keep(materialize(...))`` outlives the block (and lasts as long as the block around it, if there is one).
    """
    made: list[str] = []
    around = _passing[-1] if _passing else None
    _passing.append(made)

    def keep(df: DataFrame) -> DataFrame:
        path = made.pop()
        if around is not None:
            around.append(path)
        return df

    try:
        yield keep
    finally:
        _passing.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
