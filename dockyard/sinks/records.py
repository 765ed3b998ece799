"""Order sinks: the wide append log and the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.shape import rename_columns, rows_to_records
from ..schema import ORDER_COLUMNS


def record_rows(flat: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The 24 order fields under logical names; the receipt time has no header and is not sent."""
    return rename_columns(flat.select(ORDER_COLUMNS), mapping)


def record_documents(flat: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The same rows as JSON records."""
    return rows_to_records(record_rows(flat, mapping))


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; a repeated batch replaces itself."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/batch_id={batch_id}")
