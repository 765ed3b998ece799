"""Exact deduplication over a cuckoo-filter index of live digests.

The index is a table of shards. A shard holds the full digests of its live texts (the bucketed content) with
their counts and keepers, and a cuckoo filter over them. Each task combines its rows of a batch to one per distinct
text (again after MOST others) before they are shuffled by shard, so a text that a third of all rows repeat travels as one
row per task. Each shard then probes its filter: a miss proves a digest new; a hit is verified against the digests
stored in the bucket, where copies and keeper are merged, or proves false. Insertions that find no place after a bounded number of evictions
double the table, which is filled again from the stored keys. Deletions take one fingerprint out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.tables import fresh, keep, lowered
from dockyard.session import new_folder

#: Digests a shard is planned for, and the least number of shards (small shards cost little, many keep tasks even).
SHARD_KEYS = 50_000
LEAST_SHARDS = 256
#: Digests a task holds while it combines its rows.
MOST = 1 << 17

STATE = "shard int, digest binary, copies long, keep_id long, keep_row long, filter binary"
ARROW = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("copies", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("filter", pa.binary())])


BATCH = pa.schema([f for f in ARROW if f.name not in ("shard", "filter")])


def _merge(held: list, copies: int, keep_id: int | None, keep_row: int) -> None:
    """Adds copies to [copies, keep_id, keep_row]; the largest id, then row, is the keeper, and no id is the smallest."""
    held[0] += copies
    held[1:] = max((held[1:], [keep_id, keep_row]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 marks a free place. Digests are 32 bytes, evenly spread."""

    SLOTS = 4
    MOST_KICKS = 200

    def __init__(self, buckets: int = 8, table: bytes | None = None):
        self.places = [0] * (buckets * self.SLOTS) if table is None else np.frombuffer(table, np.uint16).tolist()
        self.mask = len(self.places) // self.SLOTS - 1

    @staticmethod
    def parts(digest: bytes) -> tuple[int, int]:
        """The fingerprint (never 0) and the number whose low bits name the first bucket."""
        return int.from_bytes(digest[8:10], "little") or 1, int.from_bytes(digest[10:18], "little")

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _buckets(self, digest: bytes) -> tuple[int, int, int]:
        mark, spot = self.parts(digest)
        first = spot & self.mask
        return mark, first, self.other(first, mark)

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self._buckets(digest)
        n = self.SLOTS
        return mark in self.places[first * n : first * n + n] or mark in self.places[second * n : second * n + n]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
            if not self.places[i]:
                self.places[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the table has to grow; the filter is then of no more use."""
        mark, first, second = self._buckets(digest)
        if self._put(first, mark) or self._put(second, mark):
            return True
        bucket = second
        for kick in range(self.MOST_KICKS):
            i = bucket * self.SLOTS + kick % self.SLOTS
            mark, self.places[i] = self.places[i], mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for a digest that is known to be stored."""
        mark, first, second = self._buckets(digest)
        for bucket in (first, second):
            for i in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.places[i] == mark:
                    self.places[i] = 0
                    return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.places, np.uint16).tobytes()

    @classmethod
    def of(cls, digests: Iterable[bytes], buckets: int = 8) -> CuckooFilter:
        """A filter of all the stored keys, doubled until they fit."""
        held = list(digests)
        while buckets * cls.SLOTS * 0.9 < len(held):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(map(made.insert, held)):
                return made
            buckets *= 2


class Shard:
    """One shard in a task: the filter and the bucketed content it guards."""

    def __init__(self, rows: list[tuple]):
        """Rows as in STATE without the shard."""
        blob = next((r[4] for r in rows if r[4] is not None), None)
        self.content = {r[0]: list(r[1:4]) for r in rows if r[0] is not None}
        self.filter = CuckooFilter.of(self.content) if blob is None else CuckooFilter(table=blob)

    def insert(self, digest: bytes, copies: int, keep_id: int | None, keep_row: int) -> None:
        if digest in self.filter and (held := self.content.get(digest)) is not None:  # a hit, verified
            _merge(held, copies, keep_id, keep_row)
            return
        self.content[digest] = [copies, keep_id, keep_row]  # a miss, or a hit that proved false
        if not self.filter.insert(digest):
            self.filter = CuckooFilter.of(self.content, 2 * (self.filter.mask + 1))

    def delete(self, digest: bytes) -> None:
        if digest in self.filter and digest in self.content:
            del self.content[digest]
            self.filter.delete(digest)

    def rows(self) -> list[tuple]:
        return [*((d, *x, None) for d, x in self.content.items()), (None, None, None, None, self.filter.to_bytes())]


def _changes(delete: bool):
    """Streams rows sorted by shard, a shard's stored state before its batch, and gives each shard's next state."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, batch = None, [], []

        def changed() -> pa.RecordBatch:
            shard = Shard(stored)
            for digest, copies, keep_id, keep_row, _ in batch:
                if delete:
                    shard.delete(digest)
                else:
                    shard.insert(digest, copies, keep_id, keep_row)
            columns = zip(*((now, *r) for r in shard.rows()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for table in tables:
            for shard, new, *row in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield changed()
                    now, stored, batch = shard, [], []
                (batch if new else stored).append(tuple(row))
        if now is not None:
            yield changed()

    return run


def combined(digests: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (digest, keep_id, keep_row) as (digest, copies, keep_id, keep_row), one per digest and task, or again after ``most`` others."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flushed() -> pa.RecordBatch:
            columns = zip(*((d, *x) for d, x in held.items()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, BATCH, strict=True)], schema=BATCH)

        for table in tables:
            for digest, keep_id, keep_row in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if (known := held.get(digest)) is not None:
                    _merge(known, 1, keep_id, keep_row)
                    continue
                if len(held) >= most:
                    yield flushed()
                    held.clear()
                held[digest] = [1, keep_id, keep_row]
        if held:
            yield flushed()

    rows = digests.select("digest", F.col("keep_id").cast("long"), F.col("keep_row").cast("long"))
    return rows.mapInArrow(run, "digest binary, copies long, keep_id long, keep_row long")


def digest_of(text: Column) -> Column:
    """SHA-256 of the text as UTF-8 with A-Z lower-cased, as binary; null counts as empty."""
    return F.unhex(F.sha2(lowered(text).cast("binary"), 256))


@dataclass
class CuckooIndex:
    """The index as a table in the shared folder; every change writes the next version of it."""

    spark: SparkSession
    shards: int
    path: str | None = None

    def state(self) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.path)

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))

    def _changed(self, batch: DataFrame, delete: bool) -> CuckooIndex:
        path = new_folder(self.spark, "cuckoo")
        names = ["shard", "new", "digest", "copies", "keep_id", "keep_row", "filter"]
        batch = self._shard(batch).select("shard", F.lit(True).alias("new"), *names[2:6], F.lit(None).cast("binary").alias("filter"))
        rows = self.state().withColumn("new", F.lit(False)).select(names).unionByName(batch)
        rows = rows.repartition("shard").sortWithinPartitions("shard", "new")
        rows.mapInArrow(_changes(delete), STATE).write.parquet(path)
        return CuckooIndex(self.spark, self.shards, path)

    def insert(self, digests: DataFrame) -> CuckooIndex:
        """Adds rows (digest, keep_id, keep_row); of equal digests the largest id, then row, is the keeper."""
        return self._changed(combined(digests), False)

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """Takes the texts of these digests out, all copies of each; digests that are not live change nothing."""
        none = F.lit(None).cast("long")
        return self._changed(digests.select("digest", none.alias("copies"), none.alias("keep_id"), none.alias("keep_row")).distinct(), True)

    def live(self) -> DataFrame:
        """(digest, copies, keep_id, keep_row), one row per live text."""
        return self.state().where("digest is not null").select("digest", "copies", "keep_id", "keep_row")


def dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the row's number.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts make
    one group. The largest doc_id stays (a null id is smaller than any); of repeated rows with one id and
    text exactly one is kept. An empty table gives no rows. Only doc_id and text are read, other columns may
    have any name.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    index = CuckooIndex(spark, shards or max(LEAST_SHARDS, -(-rows.count() // SHARD_KEYS)))
    index = index.insert(rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    return rows.join(index.live(), "digest").select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`dedup` keeps, with all their columns; one of rows repeated whole stays."""
    key, seen, number = fresh(docs, "dedup_key"), fresh(docs, "dedup_id"), fresh(docs, "dedup_number")
    kept = dedup(docs).where("kept").select(F.unhex("text_sha256").alias(key), F.col("doc_id").alias(seen))
    found = docs.withColumn(key, digest_of(docs["text"]))
    found = found.join(kept, (found[key] == kept[key]) & docs["doc_id"].cast("long").eqNullSafe(kept[seen]), "left_semi")
    return one_each(found, [key, "doc_id"], number).drop(key)


def one_each(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """One row for each value of the keys; rows repeated under one id are few, so the groups are."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    return df.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
