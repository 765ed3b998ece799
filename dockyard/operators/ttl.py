"""Anchored time-to-live deduplication.

An arrival is accepted when its key has no anchor or the anchor has expired; the accepted arrival
becomes the new anchor. A rejected arrival changes nothing, so repeats never renew the time to live.
A null, blank or (numeric) zero key is never a duplicate.

A count per key, which combines before its shuffle, sorts the keys into three kinds. A key seen once
is decided from that count alone. A key with few arrivals is folded inside one row, in one linear pass. A TTL is
elapsed time in every branch, so the kinds agree whatever the session time zone is; only the plan depends on the bound.
The arrivals of a key with more than ``group_bound`` are never gathered: they are sorted into chunks of
(key, time), as many as it takes. An arrival's successor is the first one at or after its expiry. A task follows the
successors inside its chunk; what leaves a chunk is, for each arrival of its first TTL (no other can be the
first accepted one there), when the key is open again. An as-of join links these entries from chunk to chunk, and pointer
doubling marks the ones that the key's first arrival leads to: rounds grow with the logarithm of the chunks a key
passes, or of its time span in TTLs where that is less.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.times import ONE_DAY, elapsed_after, instant_micros, time_literal
from ..session import materialise, new_folder
from .asof import asof_join
from .links import walk

# Most arrivals of one key that are gathered into one row.
GROUP_BOUND = 20_000

# Arrivals of hot keys that one task sorts and follows, 16 bytes each and what the key and the sequence number take.
CHUNK_ROWS = 1 << 21

_NEVER = datetime(9999, 12, 31)


def classify_arrivals(
    df: DataFrame,
    key: str = "id",
    ts: str = "received_at",
    seq: str = "seq",
    ttl: timedelta = ONE_DAY,
    ledger: DataFrame | None = None,
    group_bound: int = GROUP_BOUND,
    chunk_rows: int | None = None,
    work: str | None = None,
) -> DataFrame:
    """Every arrival as ``(key, ts, seq, accepted)``.

    Arrivals are ordered by ``(ts, seq)``; ``seq`` is unique. ``ledger(k, expires_at)`` holds earlier
    acceptances; a null expiry never ends. Only the three columns are shuffled; join back on ``seq``,
    which spreads evenly whatever the keys are. ``work`` names a folder for intermediate tables that
    may be overwritten once the result has been stored; by default each call takes a new one.
    """
    narrow = df.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    verdicts = _union(_decide(narrow, ttl, ledger, group_bound, chunk_rows or CHUNK_ROWS, work))
    return verdicts.withColumnsRenamed({"k": key, "ts": ts, "seq": seq})


def accepted_arrivals(
    df: DataFrame,
    key: str = "id",
    ts: str = "received_at",
    seq: str = "seq",
    ttl: timedelta = ONE_DAY,
    ledger: DataFrame | None = None,
    group_bound: int = GROUP_BOUND,
    chunk_rows: int | None = None,
    work: str | None = None,
) -> DataFrame:
    """The accepted arrivals only, as ``(key, ts, seq)``."""
    narrow = df.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    accepted = _union(_decide(narrow, ttl, ledger, group_bound, chunk_rows or CHUNK_ROWS, work, accepted_only=True))
    return accepted.drop("accepted").withColumnsRenamed({"k": key, "ts": ts, "seq": seq})


def drop_repeats(df: DataFrame, key: str = "id", ts: str = "received_at", seq: str = "seq", **options) -> DataFrame:
    """``df`` without its rejected arrivals, all columns kept.

    ``df`` is read three times, twice for the three deciding columns only, so it should be a table.
    Rejections are few in an ordinary feed. They are stored first: planned by their real size, the
    anti-join then leaves the wide rows where they are.
    """
    rejected = classify_arrivals(df, key, ts, seq, **options).where(~F.col("accepted")).select(seq)
    return df.join(materialise(rejected, new_folder(df.sparkSession, "rejected")), seq, "left_anti")


def ledger_entries(accepted: DataFrame, key: str = "id", ts: str = "received_at", ttl: timedelta = ONE_DAY) -> DataFrame:
    """Ledger rows of accepted arrivals: key, acceptance and expiry. Blank keys leave no entry."""
    is_number = isinstance(accepted.schema[key].dataType, NumericType)
    expires = elapsed_after(F.col(ts), ttl, accepted.schema[ts].dataType)
    return accepted.where(F.col(key) != (0 if is_number else "")).select(
        F.col(key).alias("k"), F.col(ts).alias("accepted_at"), expires.alias("expires_at")
    )


def _decide(
    narrow: DataFrame,
    ttl: timedelta,
    ledger: DataFrame | None,
    bound: int,
    chunk_rows: int,
    work: str | None,
    accepted_only: bool = False,
) -> list[DataFrame]:
    """Verdicts ``(k, ts, seq, accepted)`` by kind of key; ``accepted_only`` leaves the rejected ones out."""
    spark = narrow.sparkSession
    is_number = isinstance(narrow.schema["k"].dataType, NumericType)
    is_blank = F.coalesce(F.col("k") == (0 if is_number else ""), F.lit(True))
    parts = [narrow.where(is_blank).withColumn("accepted", F.lit(True))]
    keyed = narrow.where(~is_blank)

    # Each kind has its own folder, so a join with one of them is planned by that kind's real size.
    work = work or new_folder(spark, "arrivals")
    kinds = f"{work}/kinds"
    counts = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    kind = F.when(F.col("n") == 1, "one").when(F.col("n") <= bound, "few").otherwise("hot")
    _replace(counts.withColumn("kind", kind), "kind", kinds)
    by_kind = spark.read.schema(counts.schema).option("basePath", kinds)
    present = {r["kind"]: r["n"] for r in spark.read.schema("kind string, n long").parquet(kinds).groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    # Only ledger rows of keys that arrived matter; a small set of keys filters the ledger where it lies.
    expiry = None
    if ledger is not None:
        arrived = spark.read.schema(counts.schema).parquet(kinds).select("k")
        expiry = _expiry_by_key(ledger.join(arrived, "k", "left_semi"))

    if "one" in present:
        single = by_kind.parquet(f"{kinds}/kind=one").select("k", "ts", "seq")
        decided = single.withColumn("accepted", F.lit(True)) if expiry is None else _past_expiry(single, expiry)
        parts.append(decided.where("accepted") if accepted_only else decided)
    if "hot" in present:
        # Taken out before the other keys are shuffled, so that no shuffle on the key meets a hot one.
        hot_keys = by_kind.parquet(f"{kinds}/kind=hot").select("k")
        rows, kept = _follow_chunks(keyed.join(hot_keys, "k", "left_semi"), ttl, expiry, present["hot"] // chunk_rows + 1, f"{work}/hot")
        keyed = keyed.join(hot_keys, "k", "left_anti")
        taken = kept.withColumn("accepted", F.lit(True))
        if accepted_only:
            parts.append(taken)
        else:
            verdict = F.coalesce("accepted", F.lit(False)).alias("accepted")
            parts.append(rows.join(taken.select("seq", "accepted"), "seq", "left").select("k", "ts", "seq", verdict))
    if "few" in present:
        few = keyed.join(by_kind.parquet(f"{kinds}/kind=few").select("k"), "k", "left_semi")
        folded = _fold(few, ttl, expiry)
        if accepted_only:
            parts.append(_exploded(folded).withColumn("accepted", F.lit(True)))
        else:
            verdicts = folded.select("k", F.explode("flagged").alias("a"))
            parts.append(verdicts.select("k", "a.ts", "a.seq", "a.accepted"))
    return parts


def _past_expiry(single: DataFrame, expiry: DataFrame) -> DataFrame:
    is_open = F.col("open_at").isNull() | (F.col("ts") >= F.col("open_at"))
    return single.join(expiry, "k", "left").select("k", "ts", "seq", is_open.alias("accepted"))


def _expiry_by_key(ledger: DataFrame) -> DataFrame:
    """One row per key: the time from which it is accepted again."""
    end = F.coalesce("expires_at", time_literal(_NEVER, ledger.schema["expires_at"].dataType))
    return ledger.groupBy("k").agg(F.max(end).alias("open_at"))


def _fold(rows: DataFrame, ttl: timedelta, state: DataFrame | None) -> DataFrame:
    """Per key: arrivals in order with their verdict (``flagged``), the accepted ones as ``kept`` and the last expiry ``open_at``."""
    grouped = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("arrivals"))
    ts_type = rows.schema["ts"].dataType
    if state is None:
        grouped = grouped.withColumn("open_at", F.lit(None).cast(ts_type))
    else:
        grouped = grouped.join(state, "k", "left")
    width = ttl // timedelta(microseconds=1)

    # One pass over each key's sorted arrivals; the times alone go to Python, in Arrow batches.
    @F.pandas_udf("array<boolean>")
    def verdicts(times: pd.Series, opens: pd.Series) -> pd.Series:
        out = []
        for arrivals, start in zip(times, opens):
            open_at = None if start != start or start is None else int(start)
            flags = []
            for t in arrivals.tolist():
                taken = open_at is None or t >= open_at
                if taken:
                    open_at = t + width
                flags.append(taken)
            out.append(flags)
        return pd.Series(out, dtype=object)

    def micros(x: Column) -> Column:
        return instant_micros(x, ts_type)

    times = F.transform("arrivals", lambda x: micros(x["ts"]))
    flagged = grouped.withColumn("_flags", verdicts(times, micros(F.col("open_at"))))
    flagged = flagged.withColumn("flagged", F.zip_with("arrivals", "_flags", lambda x, f: F.struct(x["ts"].alias("ts"), x["seq"].alias("seq"), f.alias("accepted"))))
    kept = F.transform(F.filter("flagged", lambda x: x["accepted"]), lambda x: F.struct(x["ts"].alias("ts"), x["seq"].alias("seq")))
    flagged = flagged.withColumn("kept", kept)
    last = elapsed_after(F.element_at("kept", -1)["ts"], ttl, ts_type)
    return flagged.select("k", "flagged", "kept", F.when(F.size("kept") > 0, last).otherwise(F.col("open_at")).alias("open_at"))


def _exploded(folded: DataFrame) -> DataFrame:
    return folded.select("k", F.explode("kept").alias("a")).select("k", "a.ts", "a.seq")


def _follow_chunks(hot: DataFrame, ttl: timedelta, expiry: DataFrame | None, parts: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, kept)`` of the hot keys, followed in ``parts`` chunks."""
    rows = hot
    if expiry is not None:
        # What comes before an earlier acceptance has expired starts nothing.
        rows = hot.join(expiry, "k", "left").where(F.col("open_at").isNull() | (F.col("ts") >= F.col("open_at"))).select("k", "ts", "seq")
    width = ttl // timedelta(microseconds=1)
    ts_type = hot.schema["ts"].dataType
    narrow = rows.select("k", instant_micros(F.col("ts"), ts_type).alias("t"), "ts", "seq")
    order = ["k", "t", "seq"]
    dealt = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().cast("long").alias("chunk"), F.monotonically_increasing_id().alias("node"))
    added = StructType().add("open_t", "long").add("last", "long").add("starts", "boolean")
    schema = StructType([*dealt.schema.fields, *added.fields])
    chunks = materialise(dealt.mapInArrow(_left_open(width), schema), f"{folder}/chunks")

    entries = chunks.where("open_t is not null").select("k", "t", "node", "open_t", "last", "chunk", "starts")
    span = entries.agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count_distinct("chunk").alias("chunks")).first()
    # A walk enters a chunk once, and leaves at least one TTL between two entries.
    hops = min(span["chunks"], (span["high"] - span["low"]) // width + 1) - 1 if span["chunks"] else 0
    # Stored by itself, so that the chunks meet a table of their own.
    taken = materialise(_entered(entries, hops, folder), f"{folder}/entered")
    taken = taken.select(F.col("chunk").alias("in_chunk"), F.col("node").alias("first"), F.col("last").alias("last_node"))
    kept = chunks.select("chunk", "k", "t", "ts", "seq", "node").groupBy("chunk").cogroup(taken.groupBy("in_chunk")).applyInArrow(_accepted_in(width), rows.schema)
    return hot.select("k", "ts", "seq"), materialise(kept, f"{folder}/kept")


def _entered(entries: DataFrame, hops: int, folder: str) -> DataFrame:
    """The entries through which the walks of the keys pass: (chunk, node, last)."""
    # A key's first arrival is the first of its entries; the count of keys' chunks is all that is grouped here.
    first = entries.where("starts").groupBy("k").agg(F.min("node").alias("node")).select("node")
    held = entries.select("chunk", "node", "last")
    if hops < 1:
        return held.join(first, "node", "left_semi")
    targets = entries.select("k", F.col("t").alias("entry_t"), F.col("node").alias("next"))
    links = asof_join(entries.select("k", "node", "open_t"), targets, "k", "open_t", "entry_t", ["next"], order="next", forward=True)
    reached = materialise(walk(first, links.select("node", "next"), hops).select("node"), f"{folder}/reached")
    return held.join(reached, "node", "left_semi")


def _in_utc(table: pa.Table) -> pa.Table:
    """Instants come in the session time zone and are taken back in UTC; the instant is the same."""
    fields = [f.with_type(pa.timestamp(f.type.unit, "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in table.schema]
    return table.cast(pa.schema(fields))


def _segments(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys)
    cuts = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1 if n > 1 else np.zeros(0, np.int64)
    return np.concatenate(([0], cuts, [n]))


def _left_open(width: int):
    """Adds to a chunk's rows, for each that may be the first accepted one of its key there, when the key is open again
    behind the chunk (``open_t``) and the key's last row (``last``); ``starts`` marks the key's first row in the chunk."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = _in_utc(pa.Table.from_batches(held)).combine_chunks()
        t, node = (table.column(c).to_numpy() for c in ("t", "node"))
        open_t, last = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        entry, starts = np.zeros(len(t), bool), np.zeros(len(t), bool)
        cuts = _segments(pa.concat_arrays(table.column("k").chunks))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            times = t[a:b]
            # One entry more than the first TTL holds: the first arrival behind it.
            count = min(int(np.searchsorted(times, times[0] + width, "right")) + 1, b - a)
            open_t[a : a + count] = times[_ends(times, width)[:count]] + width
            last[a : a + count] = node[b - 1]
            entry[a : a + count] = True
            starts[a] = True
        for name, values, kind in (("open_t", open_t, pa.int64()), ("last", last, pa.int64())):
            table = table.append_column(name, pa.array(values, kind, mask=~entry))
        yield from table.append_column("starts", pa.array(starts)).to_batches(1 << 16)

    return chunk


def _ends(times: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted times the place of the last one that its successors reach."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + width, "left"), n)
    end = np.arange(n)
    while True:
        on = np.flatnonzero(step[:-1] < n)
        if not len(on):
            return end
        # Both tables jump twice as far from here on.
        end[on] = end[step[on]]
        step = step[step]


def _accepted_in(width: int):
    """The accepted rows of a chunk, from the entries through which the walks pass."""

    def accepted(rows: pa.Table, entries: pa.Table) -> pa.Table:
        names = ["k", "ts", "seq"]
        if not rows.num_rows or not entries.num_rows:
            return _in_utc(rows).select(names).slice(0, 0)
        rows = _in_utc(rows).sort_by("node")
        t, node = rows.column("t").to_numpy(), rows.column("node").to_numpy()
        taken = []
        for first, last in zip(entries.column("first").to_pylist(), entries.column("last_node").to_pylist(), strict=True):
            at, end = np.searchsorted(node, [first, last + 1]).tolist()
            while at < end:
                taken.append(at)
                at += int(np.searchsorted(t[at:end], t[at] + width, "left"))
        return rows.select(names).take(pa.array(taken, pa.int64()))

    return accepted


def _replace(df: DataFrame, by: str, path: str) -> None:
    """Write ``df`` in folders; folders of an earlier write go, whatever the session's overwrite mode."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
