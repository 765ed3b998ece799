"""Large CSV files whose quoted cells hold line breaks, read in ranges by many tasks.

Whether a line begins inside a quoted cell depends on all lines before it. A line, and a whole range of lines, can
turn ``outside`` and ``inside`` into two states only, so a first pass finds both answers for each range, and one pass over the
ranges (one row each) tells where each of them really begins. The second pass cuts every range into records; only a record
that crosses the border of ranges is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, new_folder

_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def state_after(line: str, inside: bool) -> bool:
    """Whether the next line begins inside a quoted cell. A quote opens a cell only at the cell's beginning."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closing = _CLOSING.match(line, at)
            if not closing:
                return True
            at, inside = closing.end(), False
        elif at == 0 and line.startswith('"'):
            at, inside = 1, True
            continue
        opening = line.find(',"', at)
        if opening < 0:
            return False
        at, inside = opening + 2, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _turns(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The quotes that change a state: their lines, and whether they end a cell only (``resets``) or swap inside and outside.

    A run of quotes of even number changes nothing: each pair is a quote inside of a cell, or opens and closes one. The odd one of others
    closes the cell that it stands in; outside of a cell it opens one at the cell's beginning, elsewhere it is text.
    """
    offsets, data = _bytes(values)
    quotes = np.flatnonzero(data == ord('"'))
    lines = np.searchsorted(offsets, quotes, "right") - 1
    first = np.ones(len(quotes), bool)
    first[1:] = (quotes[1:] != quotes[:-1] + 1) | (lines[1:] != lines[:-1])
    runs = np.flatnonzero(first)
    runs = runs[np.diff(np.append(runs, len(quotes))) % 2 == 1]
    at, line = quotes[runs], lines[runs]
    return line, (at != offsets[line]) & (data[at - 1] != ord(","))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and the end, and the values' bytes one after the other."""
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _states(resets: np.ndarray, inside: bool) -> np.ndarray:
    """The state behind each of the quotes that change it, from the state before them."""
    swaps = np.cumsum(~resets)
    last = np.maximum.accumulate(np.where(resets, np.arange(len(resets)), -1))
    odd = (swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1
    return odd ^ ((last < 0) & inside)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a batch by range."""
    if not batch.num_rows:
        return
    files, blocks, values = (batch.column(c) for c in ("file", "block", "value"))
    places, n = blocks.to_numpy(), batch.num_rows
    changed = (places[1:] != places[:-1]) | pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (files[a].as_py(), int(places[a])), values.slice(a, b - a)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the state behind it if it begins outside or inside, and whether a record begins in it if it begins inside."""
    key, states = None, [False, True, False]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *states)], names=["file", "block", "if_out", "if_in", "begins"])

    for batch in batches:
        for found, lines in _parts(batch):
            if found != key:
                if key:
                    yield row()
                key, states = found, [False, True, False]
            # A line that begins outside begins a record.
            states[2] = states[2] or not states[1]
            line, resets = _turns(lines)
            if not len(line):
                continue
            if_out, if_in = _states(resets, states[0]), _states(resets, states[1])
            if not states[2]:
                ends = np.append(line[1:] != line[:-1], line[-1] < len(lines) - 1)
                states[2] = bool((ends & ~if_in).any())
            states[0], states[1] = bool(if_out[-1]), bool(if_in[-1])
    if key:
        yield row()


def range_states(lines: DataFrame) -> DataFrame:
    """Per range (file, block): whether it begins ``inside`` a cell, and the range in which the record it begins in has its start (``owner``)."""
    spark = lines.sparkSession
    found = lines.mapInArrow(_ranges, "file string, block long, if_out boolean, if_in boolean, begins boolean")
    found = materialise(found, new_folder(spark, "ranges"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Behind a range that ends alike from both states the state is known; from there it is followed to the next such range.
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.struct("block", F.col("if_out").alias("state")))
    known = found.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    # Between two fixed ranges a range either keeps the state or swaps it.
    swaps = F.col("if_out") & ~F.col("if_in")
    turned = F.sum(F.when(swaps, 1).otherwise(0)).over(before)
    counted = known.withColumn("turned", F.coalesce(turned, F.lit(0)))
    own = counted.select(F.col("file").alias("fixed_file"), F.col("block").alias("fixed_block"), (F.col("turned") + F.when(swaps, 1).otherwise(0)).alias("turned_there"))
    joined = counted.join(own, (F.col("file") == F.col("fixed_file")) & (F.col("fixed.block") == F.col("fixed_block")), "left")
    odd = (F.col("turned") - F.coalesce("turned_there", F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("fixed.state"), F.lit(False)) != odd
    states = joined.select("file", "block", "begins", inside.alias("inside"))
    starts = F.when(~F.col("inside") | F.col("begins"), F.col("block"))
    return states.select("file", "block", "inside", F.max(starts).over(before).alias("owner"))


def _joined(lines: pa.Array, goes_on: np.ndarray) -> pa.Array:
    """The lines without a return at their end; those that go on with a record have the line break before them."""
    offsets, data = _bytes(lines)
    full = offsets[1:] > offsets[:-1]
    if (data[offsets[1:][full] - 1] == ord("\r")).any():
        lines = pc.replace_substring_regex(lines, pattern=r"\r\z", replacement="")
    breaks = pc.if_else(pa.array(goes_on), pa.scalar("\n", lines.type), pa.scalar("", lines.type))
    return pc.binary_join_element_wise(breaks, lines, pa.scalar("", lines.type))


def _text(texts: pa.Array, a: int, b: int) -> str:
    offsets, data = _bytes(texts)
    return data[offsets[a] : offsets[b]].tobytes().decode()


def _runs(texts: pa.Array, begins: np.ndarray, end: int) -> pa.Array:
    """The texts from each of ``begins`` to the next one, the last one's to ``end``, as one value each."""
    offsets, data = _bytes(texts)
    found = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets[np.append(begins, end)]), pa.py_buffer(data))
    return found.cast(pa.string())


def _records(owners: dict[tuple[str, int], int | None]):
    """Cuts ranges into records; ``owners`` has the ranges that begin inside a cell. Whole records have no owner; parts of
    records that cross a border are given out with the range in which their record begins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, owner, number = None, [], False, None, 0

        def give(texts: pa.Array, whose: int | None) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(np.arange(number, number + n)), pa.repeat(pa.scalar(whose, pa.int64()), n), texts]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "number", "owner", "text"])

        def rest() -> pa.RecordBatch:
            # The range ends inside a cell: its open record begins here, or where the range's own part does.
            return give(pa.array(["".join(held)]), key[1] if owner is None else owner)

        for batch in batches:
            for found, lines in _parts(batch):
                if found != key:
                    if held:
                        yield rest()
                    key, held, number = found, [], 0
                    inside = key in owners
                    owner = owners.get(key)
                line, resets = _turns(lines)
                behind = np.full(len(lines), inside)
                if len(line):
                    # The state behind a line is that behind the last such quote in it or before it.
                    last = np.searchsorted(line, np.arange(len(lines)), "right") - 1
                    behind = np.where(last >= 0, _states(resets, inside)[last], inside)
                    inside = bool(behind[-1])
                texts = _joined(lines, np.append(bool(held), behind[:-1]))
                ends = np.flatnonzero(~behind) + 1
                if not len(ends):
                    held.append(_text(texts, 0, len(lines)))
                    continue
                begins = np.append(0, ends[:-1])
                if held or owner is not None:
                    yield give(pa.array(["".join([*held, _text(texts, 0, int(ends[0]))])]), owner)
                    held, owner, number = [], None, number + 1
                    begins, ends = begins[1:], ends[1:]
                if len(ends):
                    yield give(_runs(texts, begins, int(ends[-1])), None)
                    number += len(ends)
                last_end = int(np.flatnonzero(~behind)[-1]) + 1
                if last_end < len(lines):
                    held.append(_text(texts, last_end, len(lines)))
        if held:
            yield rest()

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text: (file, block, number, text). Quoted line breaks are kept as ``\\n``.

    ``(block, number)`` orders the records of a file; the first one of each file is ``(0, 0)``. The text of a range is not
    shuffled. What reaches the driver: one row for each range that begins inside a quoted cell.
    """
    lines = _lines(spark, path)
    crossing = range_states(lines).where("inside").collect()
    owners = {(r["file"], r["block"]): r["owner"] for r in crossing}
    schema = "file string, block long, number long, owner long, text string"
    parts = lines.mapInArrow(_records(owners), schema)
    whole = parts.where("owner IS NULL").drop("owner")
    if not owners:
        # A last record may still be open at the end of a file.
        whole = parts.drop("owner")
        return whole
    # The number of a record's first part tells its place; parts are few, at most two a range.
    piece = F.struct("block", "number", "text")
    crossed = parts.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    crossed = crossed.select("file", F.col("owner").alias("block"), F.get("p", F.lit(0))["number"].alias("number"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(crossed)
