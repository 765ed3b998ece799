"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on random orthonormal directions. Two vectors collide in a projection when one lies in the
window centred on the other; pairs with at least a calibrated count of collisions are verified by their cosine in double
precision. The count is set by simulation so that pairs exactly at the threshold reach it with a stated recall.

Equal vectors of a label collapse to one class first. Classes are laid out by label and a coarse order of their
projections and cut into blocks; two blocks are compared in one task, unless the boxes of their projections are further
apart than the threshold allows, which loses nothing. Tasks sort each projection of one block, find the windows of
the other's vectors by binary search and add up collisions; they give links per class and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dockyard.llm.components import components
from dockyard.llm.tables import keep

COSINE = 0.93
PROJECTIONS = 32
RECALL = 0.999
BLOCK = 1024


def directions(dim: int, most: int = PROJECTIONS) -> np.ndarray:
    """Random orthonormal directions (dim x projections), the same for every task."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0][:, : min(dim, most)]


def calibrated(dim: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[float, int]:
    """The window's half width, and the count that pairs at the threshold reach with the recall (20,000 simulated pairs)."""
    axes, random = directions(dim), np.random.default_rng(dim + 1)
    u = random.standard_normal((20_000, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = random.standard_normal(u.shape)
    v -= (v * u).sum(axis=1, keepdims=True) * u
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = cosine * u + np.sqrt(1 - cosine**2) * np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    half = float(np.sqrt(2 - 2 * cosine) / np.sqrt(dim)) * 1.25
    counts = (np.abs((u - v) @ axes) <= half).sum(axis=1)
    return half, int(np.quantile(counts, 1 - recall, method="lower"))


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """How many projections' query-centred windows hold each right vector, for each left one."""
    counts = np.zeros((len(left), len(right)), np.uint8)
    rank = np.empty(len(right), np.int16)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k])
        line = right[order, k]
        rank[order] = np.arange(len(right))
        lo = np.searchsorted(line, left[:, k] - half, "left").astype(np.int16)
        hi = np.searchsorted(line, left[:, k] + half, "right").astype(np.int16)
        counts += (rank[None, :] >= lo[:, None]) & (rank[None, :] < hi[:, None])
    return counts


def _laid_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors, their projections, and a coarse order: two bits of each of the first projections, interleaved."""
    for frame in frames:
        units, projected, order = [], [], []
        for vector in frame["embedding"]:
            x = np.asarray(vector, np.float64)
            x = x / np.abs(x).max()  # so that the norm neither overflows nor vanishes
            x = x / np.linalg.norm(x)
            p = x @ directions_of(len(x))
            cell = np.clip(np.floor(p[:8] * np.sqrt(len(x))) + 2, 0, 3).astype(int)
            z = 0
            for bit in (1, 0):
                for c in cell:
                    z = z * 2 + (int(c) >> bit & 1)
            units.append(x.tobytes())
            projected.append(p.tolist())
            order.append(z)
        yield frame[["cls", "label", "weight", "dim"]].assign(unit=units, projected=projected, z=order)


_directions: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _directions:
        _directions[dim] = directions(dim)
    return _directions[dim]


def _blocked(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Numbers blocks along the sorted rows; a block has one label and dimension, and at most ``size`` rows."""
        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for frame in frames:
            out = []
            for key in zip(frame["label"], frame["dim"], strict=True):
                if key != last or held == size:
                    number, held, last = number + 1, 0, key
                held += 1
                out.append(number)
            yield frame.assign(block=out)

    return run


def _compared(cosine: float, recall: float):
    limits: dict[int, tuple[float, int]] = {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, dim = (int(frame[c].iloc[0]) for c in ("i", "j", "dim"))
        if dim not in limits:
            limits[dim] = calibrated(dim, cosine, recall)
        half, least = limits[dim]
        units = np.frombuffer(b"".join(frame["unit"]), np.float64).reshape(len(frame), dim)
        lines = units @ directions_of(dim)
        block, cls, weight = (frame[c].to_numpy(np.int64) for c in ("block", "cls", "weight"))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        x, y = np.nonzero(collisions(lines[left], lines[right], half) >= least)
        if i == j:
            x, y = x[x < y], y[x < y]
        near = np.zeros(len(x), bool)
        for lo in range(0, len(x), 1 << 16):
            a, b = units[left[x[lo : lo + (1 << 16)]]], units[right[y[lo : lo + (1 << 16)]]]
            near[lo : lo + (1 << 16)] = (a * b).sum(axis=1) >= cosine
        a, b = left[x[near]], right[y[near]]
        links = np.bincount(a, weight[b], len(frame)) + np.bincount(b, weight[a], len(frame))
        root, edges = list(range(len(frame))), []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            s, t = find(p), find(q)
            if s != t:
                root[s] = t
                edges.append((cls[p], cls[q], 0))
        some = np.flatnonzero(links)
        rows = [(cls[k], None, int(links[k])) for k in some] + edges
        return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"a": "Int64", "b": "Int64", "links": "int64"})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Only vectors with equal, non-null labels and equal length are compared. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing, and is its own component. n_links counts other rows, copies of
    the vector included; component_id is the smallest vec_id that links reach, null ids left out; kept is
    vec_id = component_id, so rows that repeat an id are kept or not together. Pairs exactly at the threshold are linked.
    Vectors of any length are compared whole; an empty table gives no rows. Other columns aren't read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")]
    rows = keep(rows.select("*", *key, good.alias("good"), F.monotonically_increasing_id().alias("row")), "vectors")
    classes = rows.where("good").groupBy("k1", "k2").agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")).alias("m"), F.count("*").alias("weight"))
    classes = keep(classes.select("k1", "k2", F.col("m.row").alias("cls"), F.col("m.vec_id").alias("least"), "weight"), "classes")
    one = rows.select(F.col("row").alias("cls"), "label", "embedding").join(classes.select("cls", "weight"), "cls").withColumn("dim", F.size("embedding"))
    kind = dict(one.dtypes)["label"]
    laid = one.mapInPandas(_laid_out, f"cls long, label {kind}, weight long, dim int, unit binary, projected array<double>, z int")
    laid = laid.repartitionByRange("label", "dim", "z", "cls").sortWithinPartitions("label", "dim", "z", "cls")
    schema = f"cls long, label {kind}, weight long, dim int, unit binary, projected array<double>, z int, block long"
    laid = keep(laid.mapInPandas(_blocked(block), schema), "blocks")

    # Boxes of the blocks: projections are orthonormal, so the boxes' distance never exceeds their vectors'.
    boxes = laid.select("label", "dim", "block", F.posexplode("projected").alias("k", "p")).groupBy("label", "dim", "block", "k").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    boxes = boxes.groupBy("label", "dim", "block").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box"))
    boxes = keep(boxes, "boxes")
    gap = F.aggregate(
        F.zip_with("l.box", "r.box", lambda x, y: F.pow(F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)), F.lit(2.0))),
        F.lit(0.0), lambda s, x: s + x,
    )
    pairs = boxes.alias("l").join(boxes.alias("r"), F.expr("l.label = r.label and l.dim = r.dim and l.block <= r.block"))
    pairs = pairs.where(gap <= 2 - 2 * cosine + 1e-9).select(F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    placed = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    work = placed.join(laid.select("block", "cls", "weight", "dim", "unit"), "block")
    found = keep(work.groupBy("i", "j").applyInPandas(_compared(cosine, recall), "a long, b long, links long"), "links")

    roots = components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    linked = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    linked = keep(linked.join(degree, "cls", "left"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = linked.join(least, "root").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    some = rows.where("good").select("vec_id", "k1", "k2").join(answer, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    none = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
