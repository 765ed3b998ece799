"""Keyed entries with an expiry, kept as an append-only table ``(k, v, written_at, seq, expires_at)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import naive_timestamp, normalise_expiry
from ..session import materialise, new_folder

# Earlier than any reading: what holds it has expired.
_EXPIRED = "0001-01-01 00:00:00"


def put_entries(rows: DataFrame, k: Column, v: Column, written_at: Column, seq: Column, expires_at: Column) -> DataFrame:
    """Entries to append. A null ``expires_at`` never expires."""
    return rows.select(
        k.alias("k"), v.alias("v"), written_at.alias("written_at"), seq.alias("seq"), expires_at.alias("expires_at")
    )


def checked_expiry(rows: DataFrame, text: Column, now: Column, name: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """``(good, refused)``: rows to put, their expiry text read into ``name``, and rows whose text can't be read."""
    read = rows.withColumn(name, naive_timestamp(normalise_expiry(text, now)))
    return read.where(F.col(name).isNotNull()), read.where(F.col(name).isNull()).drop(name)


def stored_expiry(text: Column) -> Column:
    """Stored expiry text as a time: blank never expires (NULL), text that can't be read has expired."""
    known = F.coalesce(naive_timestamp(text), F.lit(_EXPIRED).cast("timestamp_ntz"))
    return F.when(text.isNotNull() & (text != ""), known)


def evict(entries: DataFrame, now: Column) -> DataFrame:
    """The entries that a look at ``now`` or later can still see: of each key the last one unless expired, and those written
    after ``now``. An expired entry takes the ones before it along."""
    last = (
        entries.where(F.col("written_at") <= now)
        .groupBy("k")
        .agg(F.max_by(F.struct("v", "written_at", "seq", "expires_at"), F.struct("written_at", "seq")).alias("e"))
        .select("k", "e.*")
    )
    live = F.col("expires_at").isNull() | (now < F.col("expires_at"))
    return last.where(live).unionByName(entries.where(F.col("written_at") > now))


def current_entries(entries: DataFrame, now: Column) -> DataFrame:
    """The last entry of each key, unless it has expired at ``now``. Entries written later are not seen."""
    last = (
        entries.where(F.col("written_at") <= now)
        .groupBy("k")
        .agg(F.max_by(F.struct("v", "expires_at"), F.struct("written_at", "seq")).alias("e"))
    )
    live = F.col("e.expires_at").isNull() | (now < F.col("e.expires_at"))
    return last.where(live).select("k", F.col("e.v").alias("v"), F.col("e.expires_at").alias("expires_at"))


def missing_keys(keys: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Distinct keys that have no live, non-null value and must be computed."""
    hits = current_entries(entries, now).where(F.col("v").isNotNull()).select("k")
    return keys.select("k").distinct().join(hits, "k", "left_anti")


def get_or_compute(
    keys: DataFrame, entries: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column
) -> tuple[DataFrame, DataFrame]:
    """``(values, computed)``: cached or computed ``(k, v)``, and the computed part to be put.

    ``compute`` gets the missing keys only. A computed null, blank or zero value is no value: it is
    neither returned nor saved.
    """
    hits = current_entries(entries, now).where(F.col("v").isNotNull()).select("k", "v")
    # Looked up once: hits and misses are two reads of one stored table.
    known = keys.select("k").distinct().join(hits, "k", "left")
    known = materialise(known, new_folder(keys.sparkSession, "known"))
    text = F.col("v").cast("string")
    fresh = compute(known.where(F.col("v").isNull()).select("k")).select("k", "v")
    computed = fresh.where(text.isNotNull() & (text != "") & (text != "0"))
    return known.where(F.col("v").isNotNull()).unionByName(computed), computed
