"""As-of joins: each row meets the last row of another table at or before its own place, or the first at or after it.

Both tables are sorted together over ranges of (key, place), so one key may fill any number of ranges. Within a range the
last row seen is carried along; what a range starts without comes from the ranges before it, of which one row each
reaches the driver. Nothing is ever joined on the key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..session import materialise, new_folder


def asof_join(
    left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: list[str], order: str | None = None, forward: bool = False
) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with the same ``by`` and ``right_at <= at``; null where there is none.

    ``forward`` takes the first one with ``right_at >= at``. Of rows with equal places the one with the largest ``order`` is
    the last. A null key or place meets nothing. No left row is lost or multiplied, whatever ``right`` repeats.
    """
    where = (F.col(by).isNotNull() & F.col(at).isNotNull()).alias("keyed")
    lefts = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_l"), where)
    rights = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull())
    rights = rights.select(
        F.col(by).alias("_by"), F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*values).alias("_r"),
        (F.col(order) if order else F.lit(None).cast("int")).alias("_order"),
    )
    loose = lefts.where(~F.col("keyed")).select("_l")
    both = lefts.where("keyed").drop("keyed").unionByName(rights, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())

    def way(name: str) -> Column:
        return F.col(name).desc() if forward else F.col(name).asc()

    # A right row stands before the left rows of its place; the tie lets many rows of one place fill several ranges.
    sort = [F.col("_by"), way("_at"), F.col("_kind"), way("_order"), F.col("_tie")]
    dealt = both.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    dealt = dealt.select("_part", "_by", "_kind", "_l", "_r")
    kinds = {f.name: f.dataType for f in dealt.schema}
    schema = StructType([
        StructField("_part", IntegerType()), StructField("_by", kinds["_by"]), StructField("_l", kinds["_l"]), StructField("_r", kinds["_r"]),
        StructField("_open", BooleanType()), StructField("_edge", BooleanType()),
    ])
    filled = materialise(dealt.mapInArrow(_carried, schema), new_folder(left.sparkSession, "asof"))
    edge = F.first(F.when(F.col("_edge"), F.struct("_by", "_r")), ignorenulls=True).alias("edge")
    ends = filled.groupBy("_part").agg(edge).collect()
    rows = filled.where("not _edge")
    # What a range starts with: the last row of the ranges before it, one row per range.
    starts, last = [], None
    for end in sorted(ends, key=lambda e: e["_part"]):
        if last is not None:
            starts.append((end["_part"], last["_by"], last["_r"]))
        last = end["edge"] or last
    if starts:
        held = StructType([StructField("_part", IntegerType()), StructField("_carry_by", kinds["_by"]), StructField("_carry", kinds["_r"])])
        rows = rows.join(F.broadcast(left.sparkSession.createDataFrame(starts, held)), "_part", "left")
        rows = rows.withColumn("_r", F.when(F.col("_open") & (F.col("_by") == F.col("_carry_by")), F.col("_carry")).otherwise(F.col("_r")))
    # Rows of no key are added after all, with null values.
    rows = rows.select("_l", "_r").unionByName(loose.withColumn("_r", F.lit(None).cast(kinds["_r"])))
    return rows.select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left rows of a sorted range with the right row carried to them, then the range's last right row."""
    last = None  # the last right row and its key
    before = None  # the key of the row before
    first_run, seen = True, False  # still in the range's first key; a right row of the present key has come
    part = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        by, kind, right = batch.column("_by"), batch.column("_kind").to_numpy(), batch.column("_r")
        part = batch.column("_part")[0]
        changes = np.zeros(n, bool)
        changes[0] = before is not None and by[0] != before
        if n > 1:
            changes[1:] = pc.not_equal(by.slice(1), by.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        place = np.arange(n)
        run = np.maximum.accumulate(np.where(changes, place, 0))
        source = np.maximum.accumulate(np.where(kind == 0, place, -1))
        in_first = (np.cumsum(changes) == 0) & first_run
        here = source >= run
        # Rows of the run that goes on from the batch before take its last right row.
        ongoing = np.cumsum(changes) == 0
        carried = ~here & ongoing & seen
        pool = pa.concat_arrays([last[1], right]) if last is not None else right
        shift = 1 if last is not None else 0
        index = np.where(here, source + shift, 0)
        valid = here | carried
        taken = pool.take(pa.array(index, mask=~valid))
        mine = np.flatnonzero(kind == 1)
        if len(mine):
            at = pa.array(mine)
            count = len(mine)
            yield pa.RecordBatch.from_arrays([
                batch.column("_part").take(at), by.take(at), batch.column("_l").take(at), taken.take(at),
                pa.array((in_first & ~valid)[mine]), pa.array(np.zeros(count, bool)),
            ], names=["_part", "_by", "_l", "_r", "_open", "_edge"])
        # State for the next batch.
        end_run = int(run[-1])
        seen = bool(here[-1]) or (bool(ongoing[-1]) and seen)
        if source[-1] >= 0:
            s = int(source[-1])
            last = (by.slice(s, 1), right.slice(s, 1))
        first_run = first_run and not changes.any()
        before = by[end_run]
        left_type = batch.column("_l").type
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.as_py()], pa.int32()), last[0], pa.nulls(1, left_type), last[1], pa.array([False]), pa.array([True])],
            names=["_part", "_by", "_l", "_r", "_open", "_edge"],
        )
