"""What a batch has written in full: a manifest that is written last, and readers that take no more than it names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "batch_id long, name string"


def record_commit(spark: SparkSession, root: str, batch_id: int, names: list[str]) -> None:
    """The batch's folders of these tables are whole. One small file, which appears at once or not at all."""
    rows = spark.createDataFrame([(batch_id, name) for name in names], _MANIFEST)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Numbers of the batches whose part of a table is whole."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _MANIFEST)
    return rows.where(rows["name"] == name).select("batch_id").distinct()


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table's whole batches; a batch that a lost driver left half written isn't seen."""
    return spark.read.parquet(f"{root}/{name}").join(committed(spark, root, name), "batch_id", "left_semi")


def pending(spark: SparkSession, root: str, name: str) -> set[int]:
    """Batches whose rows a sink has failed to write and nobody has written since: one number each."""
    try:
        held = spark.read.parquet(f"{root}/pending/{name}").select("batch_id").distinct()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return set()
        raise
    return {r["batch_id"] for r in held.join(committed(spark, root, name), "batch_id", "left_anti").collect()}
