"""Batch export: many records in one multipart body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plural_table

CRLF = "\r\n"


def _lines(*lines: str | Column) -> Column:
    return F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines])


def record_part(changeset: Column, content_id: Column, record: Column, url: str, table: str) -> Column:
    """One record's part of the body. The protocol's lines."""
    return _lines(
        F.concat(F.lit("--"), changeset),
        "Content-Type: application/http",
        "Content-Transfer-Encoding: binary",
        F.concat(F.lit("Content-ID: "), content_id.cast("string")),
        "",
        f"POST {url}/{plural_table(table)} HTTP/1.1",
        "Content-Type: application/json",
        "",
        record,
    )


def batch_records(df: DataFrame, pos: str, record: str, batch_size: int) -> DataFrame:
    """``(batch_id, records)`` in ``pos`` order. ``pos`` is a unique row number, so a batch is bounded."""
    numbered = df.select(
        F.floor(F.col(pos) / F.lit(batch_size)).cast("long").alias("batch_id"),
        F.struct(F.col(pos).alias("pos"), F.col(record).alias("record")).alias("p"),
    )
    return numbered.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list("p")), lambda p: p["record"]).alias("records")
    )


def batch_envelopes(
    df: DataFrame, pos: str, record: str, url: str, table: str, batch_size: int = 500
) -> DataFrame:
    """``(batch_id, n_records, body)``, one row per batch.

    Boundaries come from the batch number, not from random ids, so a rerun gives the same body.
    """
    name = F.col("batch_id").cast("string")
    batch, changeset = F.concat(F.lit("batch_"), name), F.concat(F.lit("changeset_"), name)
    parts = F.transform("records", lambda r, i: record_part(changeset, i, r, url, table))
    body = _lines(
        F.concat(F.lit("--"), batch),
        F.concat(F.lit("Content-Type: multipart/mixed; boundary="), changeset),
        "",
        F.concat_ws(CRLF, parts),
        F.concat(F.lit("--"), changeset, F.lit("--")),
        F.concat(F.lit("--"), batch, F.lit("--")),
    )
    return batch_records(df, pos, record, batch_size).select(
        "batch_id", F.size("records").cast("long").alias("n_records"), body.alias("body")
    )
