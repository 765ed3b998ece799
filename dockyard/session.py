"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tested with; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName("dockyard")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture for every column expression costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="dockyard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/dockyard/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table and read it back: cuts lineage and gives Catalyst the real size."""
    options = {"compression": compression} if compression else {}
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of each query that runs inside go when it ends; for queries whose plan nothing runs again."""
    conf, setting = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        yield
    finally:
        conf.set(setting, before) if before is not None else conf.unset(setting)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan over all cores when it has fewer splits than cores and its rows are costly to work on.

    Such an input holds at most a split per core, so the exchange is small; larger ones are left alone, and those whose files
    keep three quarters of the cores busy, since files that can't be split may hold much.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 4 * df.rdd.getNumPartitions() >= 3 * cores else df.repartition(cores, *keys)
