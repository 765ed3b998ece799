"""A stored table of expiring entries: a base, the puts since, and a pointer to the pair that counts.

A put adds a folder. Compaction writes a new base without what has expired or was replaced, then a new pointer; readers that
began before go on with the base and the puts they have listed, which stay until they are vacuumed. The pointer and the puts' own
records name what is whole, so a half-written or damaged put is set aside instead of ending every look.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .cache import current_entries, evict, stored_expiry

_PUTS = "put string, n long"
_POINTERS = "generation long, base string, folded array<string>"


class EntryStore:
    """Entries ``(k, v, written_at, seq, expires_at)`` below ``root``; ``expires_at`` is stored as text, as it was put.

    One writer compacts at a time: a second one that made the same generation fails on its pointer.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root
        self.schema = spark.createDataFrame([], schema).schema

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def put(self, entries: DataFrame) -> str:
        """Adds entries; returns the put's name. Its row count is recorded when its files are whole."""
        name = uuid.uuid4().hex
        seen = Observation()
        rows = entries.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.parquet(f"{self.root}/puts/{name}")
        record = self.spark.createDataFrame([(name, seen.get["n"])], _PUTS)
        record.coalesce(1).write.mode("append").parquet(f"{self.root}/put_log")
        return name

    def _pointer(self):
        return self._read("pointers/*", _POINTERS).orderBy(F.desc("generation")).first()

    def _open_puts(self, pointer) -> dict[str, int]:
        """Whole puts that the base doesn't hold; one row each."""
        folded = set(pointer["folded"]) if pointer else set()
        return {r["put"]: r["n"] for r in self._read("put_log", _PUTS).collect() if r["put"] not in folded}

    def _rows_of(self, puts: list[str]) -> DataFrame:
        # Files that can't be read give no rows here and are told by their count.
        read = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return read.parquet(*[f"{self.root}/puts/{name}" for name in puts])

    def damaged(self) -> list[str]:
        """Puts of which not all rows can be read."""
        want = self._open_puts(self._pointer())
        return sorted(name for name, n in want.items() if n and self._found(list(want)).get(name, 0) != n)

    def _found(self, puts: list[str]) -> dict[str, int]:
        if not puts:
            return {}
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/puts/([0-9a-f]{32})/", 1).alias("put")
        return {r["put"]: r["count"] for r in self._rows_of(puts).groupBy(name).count().collect()}

    def entries(self) -> DataFrame:
        """All entries of the base and of the puts behind it; damaged puts are left out whole."""
        return self._snapshot()[0]

    def _snapshot(self) -> tuple[DataFrame, list[str]]:
        pointer = self._pointer()
        want = self._open_puts(pointer)
        found = self._found(list(want))
        whole = [name for name, n in want.items() if found.get(name, 0) == n]
        parts = list(self._parts(pointer, [name for name in whole if want[name]]))
        rows = parts[0] if parts else self.spark.createDataFrame([], self.schema)
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows, list(want)

    def _parts(self, pointer, puts: list[str]) -> Iterator[DataFrame]:
        if pointer:
            yield self.spark.read.schema(self.schema).parquet(f"{self.root}/{pointer['base']}")
        if puts:
            yield self.spark.read.schema(self.schema).parquet(*[f"{self.root}/puts/{name}" for name in puts])

    def _timed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("expires_at", stored_expiry(F.col("expires_at")))

    def look(self, now: Column) -> DataFrame:
        """``(k, v, expires_at)`` live at ``now``. Text that can't be read as a time has expired."""
        return current_entries(self._timed(self.entries()), now)

    def compact(self, now: Column) -> int:
        """Stores the entries that looks at ``now`` or later can see, as a new generation; returns its number.

        Damaged puts are recorded in ``aside`` and no longer read: what they held is as never put.
        """
        pointer = self._pointer()
        generation = pointer["generation"] + 1 if pointer else 1
        aside = self.damaged()
        rows, puts = self._snapshot()
        # The text as put stays beside the time that it is read as.
        texts = rows.withColumn("_text", F.col("expires_at"))
        kept = evict(self._timed(texts).withColumn("v", F.struct("v", "_text")).drop("_text"), now)
        kept = kept.select("k", F.col("v.v").alias("v"), "written_at", "seq", F.col("v._text").alias("expires_at"))
        base = f"base/generation={generation}"
        kept.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/{base}")
        if aside:
            self.spark.createDataFrame([(name, generation) for name in aside], "put string, generation long").coalesce(1).write.mode("append").parquet(f"{self.root}/aside")
        folded = sorted({*(pointer["folded"] if pointer else []), *puts})
        # The base counts from the moment its pointer is there; a second writer of the same generation fails here.
        self.spark.createDataFrame([(generation, base, folded)], _POINTERS).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/pointers/{generation}")
        return generation

    def vacuum(self) -> None:
        """Empties the folders that the newest pointer no longer names; call it when no reader of an older one is left."""
        pointer = self._pointer()
        if not pointer:
            return
        nothing = self.spark.createDataFrame([], self.schema)
        for number in range(1, pointer["generation"]):
            nothing.write.mode("overwrite").parquet(f"{self.root}/base/generation={number}")
        for name in pointer["folded"]:
            nothing.write.mode("overwrite").parquet(f"{self.root}/puts/{name}")
