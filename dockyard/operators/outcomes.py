"""Outcome rows, the error log and the status board."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.times import received_at_local, wall_text
from ..schema import FAILED, MSG_DUPLICATE, MSG_FAILED, MSG_UPLOADED, SUCCESS
from ..session import materialise, new_folder


def outcome_rows(
    classified: DataFrame, key: str = "id", ts: str = "received_at", keep: list[str] | None = None,
    sink_failed: Column | None = None,
) -> DataFrame:
    """The answer to each arrival. ``sink_failed``: its record did not reach the table."""
    duplicate = ~F.col("accepted")
    broken = F.coalesce(sink_failed, F.lit(False)) if sink_failed is not None else F.lit(False)
    return classified.select(
        *(keep or []),
        received_at_local(F.col(ts)).alias("date_received"),
        F.col(key).cast("string").alias("uploaded_oe"),
        F.when(duplicate | broken, FAILED).otherwise(SUCCESS).alias("status"),
        F.when(duplicate, MSG_DUPLICATE).when(broken, MSG_FAILED).otherwise(MSG_UPLOADED).alias("message"),
        F.when(duplicate, 409).when(broken, 500).otherwise(200).alias("code"),
    )


def error_log(rows: DataFrame, script: str, at: Column, description: Column, message: Column) -> DataFrame:
    """Log rows: script, time to the second, description, message."""
    return rows.select(
        F.lit(script).alias("script_name"),
        F.substring(wall_text(at), 1, 19).alias("logged_at"),
        description.alias("description"),
        message.alias("message"),
    )


# The board cell each kind of update is written to.
BOARD_CELLS = {"progress": "E", "runs": "F", "duration": "G"}


# Parts of a stored board; a batch rewrites the parts that its rows fall in.
BOARD_PARTS = 64


def board_cells(updates: DataFrame) -> DataFrame:
    """Last value per (row, cell) with the update's place: (row_no, cell, value, at, seq). Combines before the shuffle."""
    cell = F.lit(None).cast("string")
    for field, name in BOARD_CELLS.items():
        cell = F.when(F.col("field") == field, name.lower()).otherwise(cell)
    last = F.max_by(F.struct("value", "at", "seq"), F.struct("at", "seq")).alias("u")
    return updates.withColumn("cell", cell).where("cell IS NOT NULL").groupBy("row_no", "cell").agg(last).select("row_no", "cell", "u.*")


def upsert_board(spark: SparkSession, root: str, updates: DataFrame, parts: int = BOARD_PARTS) -> None:
    """Merges a batch of updates into the board stored below ``root``.

    An update counts unless the stored cell comes from a later one, so batches may come in any order and again. Only the
    folders of rows that the batch updates are read and written.
    """
    part = F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int")
    fresh = materialise(board_cells(updates).withColumn("part", part), new_folder(spark, "board"))
    touched = [r["part"] for r in fresh.select("part").distinct().collect()]
    if not touched:
        return
    stored = _stored(spark, root, fresh.schema)
    both = stored.where(F.col("part").isin(touched)).unionByName(fresh)
    last = F.max_by(F.struct("value", "at", "seq"), F.struct("at", "seq")).alias("u")
    merged = both.groupBy("part", "row_no", "cell").agg(last).select("row_no", "cell", "u.*", "part")
    # Whole before anything is replaced: a run that stops in between is repeated with the same result.
    merged = materialise(merged, new_folder(spark, "board"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/board")


def _stored(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/board")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_board(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The stored board in the columns of ``status_board``; ``schema`` is that of ``board_cells``."""
    stored = _stored(spark, root, StructType([*schema.fields, StructField("part", IntegerType())]))
    cells = [F.max(F.when(F.col("cell") == name.lower(), F.struct("value")))["value"].alias(name.lower()) for name in BOARD_CELLS.values()]
    return stored.groupBy("row_no").agg(*cells)


def status_board(updates: DataFrame) -> DataFrame:
    """Last value per (row, cell) of ``updates(row_no, field, value, at, seq)``, one column per cell.

    One aggregate fills all three cells, so nothing is pivoted afterwards.
    """
    order = F.struct("at", "seq")
    cells = [
        F.max_by(F.when(F.col("field") == field, F.col("value")), F.when(F.col("field") == field, order))
        .alias(cell.lower())
        for field, cell in BOARD_CELLS.items()
    ]
    return updates.where(F.col("field").isin(list(BOARD_CELLS))).groupBy("row_no").agg(*cells)
