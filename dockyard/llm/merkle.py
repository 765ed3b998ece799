"""A Merkle manifest of a dataset: one tree per source, one tree over the sources' roots, and a witness per row.

Rows are ordered within their source by a distributed sort. Blocks of 3**LEVELS neighbouring leaves are built apart: a
block's task appends its leaves one by one to open subtrees, and whenever siblings complete a run, the witnesses of all
leaves below them grow by what the run adds. The blocks' roots are then appended in the same way, as leaves of the
next round, until each source has one root; the sources' roots are the leaves of the last tree. On the way back down, a
block's own witness is put behind those of its leaves. No task holds more than a block, and none a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockyard.llm.tables import keep

#: Children of a node, and how many levels of the tree one task builds: a block holds 3**7 = 2,187 leaves.
FAN = 3
LEVELS = 7


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtrees:
    """Open aligned subtrees of one block, to which leaves are appended from left to right.

    ``witnesses[i]`` grows by (place, siblings) with each run that the subtree of leaf i completes. ``waiting[level]`` holds
    the at most three nodes of the open run, each with the range of leaves below it.
    """

    def __init__(self):
        self.witnesses: list[list[tuple[int, str]]] = []
        self.waiting: list[list[tuple[str, int, int]]] = [[]]

    def append(self, digest: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._push(0, (digest, at, at + 1))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.waiting):
            self.waiting.append([])
        self.waiting[level].append(node)
        if len(self.waiting[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.waiting[level] = self.waiting[level], []
        for place, (_, first, last) in enumerate(run):
            siblings = "".join(digest for other, (digest, _, _) in enumerate(run) if other != place)
            for witness in self.witnesses[first:last]:
                witness.append((place, siblings))
        self._push(level + 1, (_hash("".join(digest for digest, _, _ in run)), run[0][1], run[-1][2]))

    def finish(self, levels: int) -> str:
        """Completes what is open up to ``levels`` levels and returns the root."""
        for level in range(levels):
            if level < len(self.waiting) and self.waiting[level]:
                self._complete(level)
        return self.waiting[levels][0][0]


def fold(digest: str, witness: list[tuple[int, str]]) -> str:
    """The root that a leaf and its witness lead to."""
    for place, siblings in witness:
        cut = 64 * place
        digest = _hash(siblings[:cut] + digest + siblings[cut:])
    return digest


def _written(witness: list[tuple[int, str]]) -> str:
    return ",".join(f"{place}:{siblings}" for place, siblings in witness)


def _read(text: str) -> list[tuple[int, str]]:
    return [(int(step[0]), step[2:]) for step in text.split(",")] if text else []


def _levels(n: int) -> int:
    return min(LEVELS, depth(n))


def _runs(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """A sorted partition's rows grouped by their first two columns; a group of 3**LEVELS rows or fewer is held at a time."""
    key, held = None, []
    for frame in frames:
        for row in zip(*[frame[c].tolist() for c in columns], strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def block_roots(nodes: DataFrame) -> DataFrame:
    """From nodes (g, pos, n, digest) those LEVELS levels up: (g, pos, n, digest) again."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (g, block), rows in _runs(frames, ["g", "block", "n", "digest"]):
            tree = Subtrees()
            for _, digest in rows:
                tree.append(digest)
            n = int(rows[0][0])
            out.append((g, int(block), -(-n // FAN**LEVELS), tree.finish(_levels(n))))
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=["g", "pos", "n", "digest"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["g", "pos", "n", "digest"])

    blocked = nodes.select("g", F.expr(f"pos div {FAN**LEVELS}").alias("block"), "pos", "n", "digest")
    blocked = blocked.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return blocked.select("g", "block", "n", "digest").mapInPandas(build, "g string, pos long, n long, digest string")


def rise(leaves: DataFrame) -> list[DataFrame]:
    """The node tables of all rounds, leaves first; in the last one each group has one node, its root."""
    rounds = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(keep(block_roots(rounds[-1]), "nodes"))
        most = -(-most // FAN**LEVELS)
    return rounds


def _down(nodes: DataFrame, parents: DataFrame, leaf: bool) -> DataFrame:
    """The witnesses of ``nodes`` from those of their blocks: ``parents`` (g, pos, w, subroot, root).

    Inner nodes give (g, pos, w, subroot, root); leaves give (id, leaf, subroot, root, proof, path, folded).
    """
    schema = "id string, leaf string, subroot string, root string, proof string, path string, folded string" if leaf else "g string, pos long, w string, subroot string, root string"
    names = [x.split()[0] for x in schema.split(", ")]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (g, _), rows in _runs(frames, ["g", "block", "pos", "n", "digest", "other", "id", "w", "subroot", "root"]):
            # The block's own row stands first, before place 0.
            outer, subroot, root = _read(rows[0][5]), rows[0][6], rows[0][7]
            members = rows[1:]
            tree = Subtrees()
            for member in members:
                tree.append(member[2])
            tree.finish(_levels(int(members[0][1])))
            for (pos, _, digest, other, name, _, _, _), own in zip(members, tree.witnesses, strict=True):
                witness = own + outer
                if leaf:
                    proof = "".join(siblings for _, siblings in witness)
                    path = ",".join(f"{place}/{len(siblings) // 64 + 1}" for place, siblings in witness)
                    out.append((name, digest, subroot, root, proof, path, fold(other or digest, witness)))
                else:
                    out.append((g, int(pos), _written(witness), subroot, root))
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    none, zero = F.lit(""), F.lit(0).cast("long")
    below = nodes.select(
        "g", F.expr(f"pos div {FAN**LEVELS}").alias("block"), "pos", "n", "digest", *([F.col("other"), F.col("id")] if leaf else [none.alias("other"), none.alias("id")]),
        none.alias("w"), none.alias("subroot"), none.alias("root"),
    )
    above = parents.select(
        "g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), zero.alias("n"), none.alias("digest"), none.alias("other"), none.alias("id"), "w", "subroot", "root"
    )
    both = below.unionByName(above).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return both.mapInPandas(spread, schema)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a group ``g``) with their place ``pos`` in their group, by ``order``, and the group's size ``n``.

    One range sort over (g, order) cuts a large group anywhere; places come from sizes per group and range, of which
    there are no more than groups and ranges together. Rows alike in ``order`` stand as their ``tie`` says.
    """
    sort = ["g", *order, "tie"]
    stored = keep(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    dealt = stored.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("seq", F.monotonically_increasing_id())
    dealt = keep(dealt.drop("tie").withColumn("part", F.shiftright("seq", 33)), "sorted")
    sizes = dealt.groupBy("g", "part").agg(F.count("*").alias("size"), F.min("seq").alias("first"))
    in_order = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    shifts = sizes.select(
        F.col("g").alias("g2"), F.col("part").alias("part2"),
        (F.coalesce(F.sum("size").over(in_order), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"),
    )
    shifts = keep(shifts, "shifts")
    joined = dealt.join(shifts, (F.col("g") == F.col("g2")) & (F.col("part") == F.col("part2")))
    return joined.withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "g2", "part2", "shift")


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)


def prove(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof, path, folded.

    ``proof`` holds the siblings' digests from the leaf up to the root one after the other, ``path`` the row's place in each
    run and the run's size (``0/3,1/2``). ``folded`` is the root that the proof leads to from the row's text, or from the
    text ``claimed`` where one is given (null stays null). Rows stand in their source by doc_id, null first, rows
    with one doc_id by their leaf; rows repeated whole are leaves of their own and get the proofs of their places. Null
    and empty sources are two sources; null and empty texts, too, have two leaves. A text is hashed whole, however long. An empty table
    gives no rows. Other columns aren't read, whatever their names are.
    """
    kind = docs.schema["doc_id"].dataType
    # A null source sorts first, the others bytewise.
    group = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaf = leaf_of(F.col("text"))
    rows = docs.select(group.alias("g"), "doc_id", leaf.alias("digest"), (leaf if claimed is None else leaf_of(claimed)).alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")).otherwise(""))
    leaves = keep(ranked(rows, ["doc_id", "digest"]).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id"), "placed")
    rounds = rise(leaves.select("g", "pos", "n", "digest"))
    tops = ranked(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    tops = keep(tops, "subroots")
    over = rise(tops.select("g", "pos", "n", "digest"))
    none = F.lit("")
    held = over[-1].select("g", "pos", none.alias("w"), none.alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        held = keep(_down(nodes, held, False), "witnesses")
    held = tops.drop("g").join(held.select("pos", "w", "root"), "pos")
    held = keep(held.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "w", F.col("digest").alias("subroot"), "root"), "tops")
    for nodes in reversed(rounds[1:-1]):
        held = keep(_down(nodes, held, False), "witnesses")
    proofs = _down(leaves, held, True)
    return proofs.select(F.col("id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof", "path", "folded")


def audit(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where the ids that 2 divides by their
    crc32 have lost the line breaks of their texts since the manifest was made; a null id has lost nothing."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = prove(docs, claimed)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
