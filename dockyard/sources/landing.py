"""Landed JSON-line sources: order documents and page documents, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import LANDED_ORDER, LANDED_PAGE
from ..session import spread

# Receipt times keep their microseconds; the JSON default would cut them to milliseconds.
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# Most documents of one landed file.
FILE_ROWS = 200_000


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.options(**_TIMES).schema(LANDED_ORDER).json(path), "seq")


def stream_orders(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.options(**_TIMES).schema(LANDED_ORDER)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def land_documents(docs: DataFrame, path: str) -> None:
    """Append received documents to a landing folder, compressed: a document's text is several times what it says.

    Compressed files can't be split by their readers, so they are bounded by rows.
    """
    options = {**_TIMES, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_ROWS}
    docs.select("received_at", "seq", "body").write.mode("append").options(**options).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED_PAGE).json(path)
