"""The ledger of accepted ids: a table bucketed by id, in folders by the day until which their entries expire.

A batch joins the ledger where it lies: buckets are already dealt by id, so only the batch's ids are shuffled. Folders whose
last day ended before the batch's first arrival are not even listed, so a batch's cost follows the entries that can still
refuse something, however many batches came before. A batch cuts its days into at most SLICES folders of like size, so that
the files it writes don't grow with the days it spans.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.times import instant_micros, time_literal

# Files that one batch writes at most for a folder, and tasks that join the ledger.
BUCKETS = 32

# Folders that one batch writes at most.
SLICES = 8

# Batches of so few arrivals name their ids to the scan, which then reads their buckets alone.
FEW_ROWS = 200

_DAY = 86_400_000_000


def _day(instant: Column, kind: DataType) -> Column:
    """The number of an instant's day, whatever the session time zone is."""
    return F.floor(instant_micros(instant, kind) / _DAY).cast("int")


def _last_day(entries: DataFrame, day: Column) -> Column:
    """The last day of the slice that a day falls in. Slices end at exact quantiles, so the same entries are cut alike again."""
    shares = [F.lit((i + 1) / SLICES) for i in range(SLICES - 1)]
    found = entries.agg(F.percentile(day, F.array(*shares)).alias("cuts"), F.max(day).alias("last")).first()
    ends = sorted({*map(int, found["cuts"] or []), found["last"]} - {None})
    last = F.lit(None).cast("int")
    for end in reversed(ends):
        last = F.when(day <= end, end).otherwise(last)
    return F.date_from_unix_date(last)


class Ledger:
    """Ledger rows (k, accepted_at, expires_at) below ``root``; batch by batch, each replacing what an earlier run of it wrote."""

    def __init__(self, spark: SparkSession, root: str, key: DataType, time: DataType, buckets: int = BUCKETS):
        self.spark, self.time = spark, time
        self.buckets = buckets
        self.name = f"ledger_{hashlib.sha256(root.encode()).hexdigest()[:24]}"
        if not spark.catalog.tableExists(self.name):
            # The entry in the catalog is the session's; the table is its files.
            spark.sql(
                f"CREATE TABLE {self.name} (k {key.simpleString()}, accepted_at {time.simpleString()}, expires_at {time.simpleString()}, "
                f"expires_day date, batch_id bigint) USING parquet PARTITIONED BY (expires_day, batch_id) "
                f"CLUSTERED BY (k) INTO {buckets} BUCKETS LOCATION '{root}/ledger'"
            )
            if self._stored(root):
                spark.catalog.recoverPartitions(self.name)

    def _stored(self, root: str) -> bool:
        try:
            self.spark.read.schema("batch_id long").parquet(f"{root}/ledger")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def append(self, entries: DataFrame, batch_id: int) -> None:
        day = _last_day(entries, _day(F.col("expires_at"), self.time))
        rows = entries.select("k", "accepted_at", "expires_at", day.alias("expires_day"), F.lit(batch_id).cast("long").alias("batch_id"))
        dealt = rows.repartition(self.buckets, "k")
        # Only the setting counts for a table: without it every other batch's folders would go.
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            dealt.write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(key, before)

    def live(self, batch_id: int, oldest: datetime, ids: list | None = None) -> DataFrame:
        """Entries of earlier batches that end after ``oldest``; with ``ids``, those of these ids."""
        at = time_literal(oldest, self.time)
        rows = self.spark.table(self.name).where(F.col("batch_id") < batch_id)
        # A literal, so that days are pruned when the scan is planned and files skipped by their statistics.
        first = self.spark.range(1).select(F.date_from_unix_date(_day(at, self.time)).alias("d")).first()["d"]
        rows = rows.where((F.col("expires_day") >= F.lit(first)) & (F.col("expires_at") > at))
        if ids is not None:
            rows = rows.where(F.col("k").isin(ids))
        return rows.select("k", "accepted_at", "expires_at")
