"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.llm.tables import keep

#: A node with more than one in HUBS of all edge ends is a hub; there are at most HUBS of them, so their rows are broadcast.
HUBS = 512
#: Nodes of fewer edges are never set apart.
LEAST_HUB = 1024


def hub_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (key, n, ...), where n counts the key's rows of some ``total``: keys of very many rows
    are joined by a bounded broadcast, so that no task gathers a hub. n is dropped; each key stands once in ``table``."""
    least = max(LEAST_HUB, total // HUBS)
    hubs = F.broadcast(table.where(F.col("n") > least).drop("n"))
    rest = table.where(F.col("n") <= least).drop("n")
    if total <= LEAST_HUB:
        return rows.join(table.drop("n"), key, how)
    cold = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(hubs, key).unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it reaches.

    Each round points every node's larger neighbours, then the node itself, at its smallest neighbour. Minima
    are combined before their shuffle, hubs are joined apart, edges only ever get fewer distinct ends, and a round's edges are written
    to the shared folder, so lineage stays short. Rounds grow with the logarithm of the longest path. Loops
    and repeated edges are fine; an empty edge table gives no rows; null ends are left out.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    edges = keep(edges.where("not x and not y and u > v").select("u", "v").distinct(), "edges")
    total = edges.count()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = keep(low, "lows") if total > LEAST_HUB else low
        large = hub_join(both, low, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large") if total > LEAST_HUB else large
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = keep(low, "lows") if total > LEAST_HUB else low
        small = hub_join(large, low, "u", total)
        edges = keep(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct(),
            "edges",
        )
        # The sum of hashes is the same in two rounds only when the edges are the same.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.unionByName(roots.select("u", F.col("u").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
