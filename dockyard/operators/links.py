"""Chains of links, followed by pointer doubling: a walk of n links takes about log2(n) rounds of joins, not n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, new_folder

#: A target that more links than this point at, and more than one in ``SHARE`` of all, is joined apart: there are at most
#: ``SHARE`` such targets, so these are broadcast.
CROWD = 100_000
SHARE = 512


def jump_tables(links: DataFrame, most: int) -> list[DataFrame]:
    """``links`` (node, next), one per node, as tables of jumps over 1, 2, 4, ... links, for walks of up to ``most`` links."""
    spark = links.sparkSession
    tables = [materialise(links.where("next is not null"), new_folder(spark, "jumps"))]
    n = tables[0].count()
    while 1 << len(tables) <= most:
        tables.append(materialise(_hop(tables[-1], n), new_folder(spark, "jumps")))
    return tables


def _hop(jumps: DataFrame, n: int) -> DataFrame:
    """Two jumps in one. A node may be the target of most others; nodes themselves are unique."""
    onward = jumps.select(F.col("node").alias("mid"), F.col("next").alias("end"))
    if n <= CROWD:
        return jumps.join(onward, F.col("next") == F.col("mid")).select("node", F.col("end").alias("next"))
    crowd = jumps.groupBy("next").count().where(F.col("count") > max(CROWD, n // SHARE)).select(F.col("next").alias("mid"))
    crowd = materialise(crowd, new_folder(jumps.sparkSession, "crowd"))
    few = F.broadcast(onward.join(F.broadcast(crowd), "mid", "left_semi"))
    crowded = jumps.join(few, F.col("next") == F.col("mid"))
    rest = jumps.join(F.broadcast(crowd), F.col("next") == F.col("mid"), "left_anti").join(onward, F.col("next") == F.col("mid"))
    return crowded.unionByName(rest).select("node", F.col("end").alias("next"))


def walk(starts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(node, step, ...): every node reached from ``starts`` (node, and columns to carry) by up to ``most`` links.

    The widest jumps come first, so each join doubles the resolution of the walk. A cycle is walked round until ``most``.
    """
    held = starts.withColumn("step", F.lit(0).cast("long"))
    carried = [c for c in starts.columns if c != "node"]
    if most < 1:
        return held.select("node", "step", *carried)
    tables = jump_tables(links, most)
    for power in range(len(tables) - 1, -1, -1):
        side = tables[power].select(F.col("node").alias("_from"), F.col("next").alias("_to"))
        here = F.struct("node", "step")
        there = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("node"), (F.col("step") + (1 << power)).alias("step")))
        joined = held.join(side, F.col("node") == F.col("_from"), "left")
        held = joined.select(F.explode(F.array_compact(F.array(here, there))).alias("_n"), *carried).select("_n.node", "_n.step", *carried)
    return held.where(F.col("step") <= most)
