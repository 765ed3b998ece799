"""Best-fit packing after a Martello-Toth dominance reduction.

Documents are tokenised in the tasks that read them; only lengths leave these tasks. Lengths are whole numbers up to
the sequence length, so the packing problem is a histogram of at most 1,024 counts, whatever the number of
documents: it is solved exactly as the item-by-item method would, a whole group of equal items at a time. Pieces get
their rank among those of equal length by counts per task and a running sum, and a piece's place follows from
its length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dockyard.llm.bpe import encoded
from dockyard.llm.pretokens import Cache
from dockyard.llm.tables import keep, vocabulary

CAPACITY = 1024
END = 2


def reduce(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets that dominate all alternatives, as (sizes, how often), and the counts that remain.

    ``counts[s]`` is how many items have size s. For the largest items in turn, with R the room beside one:

    * nothing fits, or one item fills R exactly: the item alone, or with that one, dominates;
    * no two items fit into R: with the largest that fits it dominates;
    * no three fit, and no two that fit exceed the largest single one: the same pair dominates;
    * no three fit, and the largest single one with its best partner covers every feasible pair, member by member:
      the triple dominates.

    Taking items away only removes alternatives, so a set that dominates does so until one of its sizes is used up.
    """
    left = counts.astype(np.int64).copy()
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*sizes: int) -> None:
        need = np.bincount(sizes, minlength=capacity + 1)
        at = np.flatnonzero(need)
        times = int((left[at] // need[at]).min())
        left[at] -= need[at] * times
        fixed.append((tuple(sorted(sizes, reverse=True)), times))

    for size in range(capacity, 0, -1):
        while left[size]:
            left[size] -= 1  # what is beside one item of this size
            beside = np.flatnonzero(left[: capacity - size + 1])
            smallest = np.repeat(beside[:3], np.minimum(left[beside[:3]], 3))[:3]
            left[size] += 1
            room = capacity - size
            if not len(beside):
                take(size)
                continue
            best = int(beside[-1])
            two, three = smallest[:2].sum(), smallest[:3].sum()
            if best == room or len(smallest) < 2 or two > room:
                take(size, best)
                continue
            if len(smallest) >= 3 and three <= room:
                break
            left[size] -= 1
            pairs = [(a, int(b)) for a in beside[::-1].tolist() for b in [_partner(left, beside, a, room - a)] if b]
            left[size] += 1
            if all(a + b <= best for a, b in pairs):
                take(size, best)
                continue
            partner = next((b for a, b in pairs if a == best), 0)
            if partner and all(max(a, b) <= best and (min(a, b) <= partner or a + b <= best) for a, b in pairs):
                take(size, best, partner)
                continue
            break
    return fixed, left


def _partner(left: np.ndarray, beside: np.ndarray, a: int, room: int) -> int:
    """The largest size beside ``a`` that fits into ``room``; a itself only where there are two."""
    for b in beside[: np.searchsorted(beside, room, "right")][::-1].tolist():
        if b != a or left[a] > 1:
            return b
    return 0


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over groups: open sequences with equal contents are one group with a count."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity, 0, -1):
        items = int(counts[size])
        moved: list[tuple[int, tuple[int, ...], int]] = []
        for room in sorted(r for r in rooms if r >= size):
            each = room // size  # an item makes its sequence the fullest that fits, so the next one goes there too
            while items and rooms[room]:
                held, n = rooms[room].pop()
                whole = min(n, items // each)
                if whole:
                    moved.append((room - each * size, held + (size,) * each, whole))
                    items -= whole * each
                if whole < n and items < each and items:
                    moved.append((room - items * size, held + (size,) * items, 1))
                    whole, items = whole + 1, 0
                if whole < n:
                    rooms[room].append((held, n - whole))
            if not items:
                break
        each = capacity // size
        if items // each:
            moved.append((capacity - each * size, (size,) * each, items // each))
        if items % each:
            moved.append((capacity - items % each * size, (size,) * (items % each), 1))
        for room, held, n in moved:
            rooms.setdefault(room, []).append((held, n))
    return [x for groups in rooms.values() for x in groups]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Slots: for each size, from which rank on its items go to which sequence, and at what offset.

    Rank r of a size belongs to the slot with the last ``first`` <= r; its sequence is ``base`` + (r - first) // each,
    its offset ``offset`` + (r - first) % each * size.
    """
    fixed, left = reduce(counts, capacity)
    rows, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for sizes, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size, each in zip(*np.unique(sizes, return_counts=True), strict=True):
            rows.append((int(size), int(used[size]), base, int(each), offset))
            used[size] += times * each
            offset += int(size * each)
        base += times
    if (used != counts).any():
        raise AssertionError("the packing must place every item")
    return pd.DataFrame(rows, columns=["size", "first", "base", "each", "offset"])


def encoder(blob: bytes):
    """Gives the ids of each of some texts, as the tokenizer file's own library does without added tokens.

    Texts are split and their distinct pre-tokens encoded once per task. The file's merges are in the order of its ids (checked),
    so a pre-token's ids are those of its bytes by rank. Texts that hold a special string go to the library itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_buffer(blob)
    spec = json.loads(blob)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special = [t["content"] for t in spec["added_tokens"]]
    ids = spec["model"]["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    made = [ids[m.replace(" ", "")] for m in merges]
    kind = spec["pre_tokenizer"]
    if made != sorted(made) or spec["normalizer"] or (kind["type"], kind["use_regex"], kind["add_prefix_space"]) != ("ByteLevel", True, False):
        raise ValueError("a byte-level BPE file is needed whose merges are in the order of its ids")
    ranks = {bytes(signs[c] for c in token): i for token, i in ids.items() if token not in special}
    core = tiktoken.Encoding("packing", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [core.encode_single_piece(w) for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum())), sizes

    cache = Cache(rows)

    def coded(texts: list[str]) -> Iterator[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if any(s in t for s in special)}
        for i, ids in enumerate(encoded([("" if i in odd else t) for i, t in enumerate(texts)], cache)):
            yield ids if i not in odd else np.array(whole.encode(texts[i], add_special_tokens=False).ids, np.int64)

    return coded


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) with, per task, the rank among its pieces of equal length."""
    held = vocabulary(docs.sparkSession, path)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded, seen = encoder(held.value), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for frame in frames:
            rows, size = [], 0
            for doc_id, code in zip(frame["doc_id"], coded(frame["text"].tolist()), strict=True):
                ids = np.append(code, end).astype("<u4")
                # The first piece is the short one; the others fill a sequence each.
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (start, stop) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part, n = ids[start:stop], stop - start
                    rows.append((doc_id, piece, start, n, zlib.crc32(part.tobytes()), task, int(seen[n]), part.astype(np.int64).tolist() if with_ids else None))
                    seen[n] += 1
                    size += n if with_ids else 1
                if size > 1 << 18:
                    yield _frame(rows, with_ids)
                    rows, size = [], 0
            yield _frame(rows, with_ids)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long" + ", ids array<long>" * with_ids
    return source.mapInPandas(made, schema)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local", "ids"]
    frame = pd.DataFrame(rows, columns=names)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame if with_ids else frame.drop(columns="ids")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as written to training files).

    Every row gives at least one piece: a null or empty text is the end id alone. Only documents longer than
    ``capacity`` are cut; their first piece is the shorter one. Rows that repeat an id, or have none, are packed
    like others. Sequences are filled without gaps from offset 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = keep(pieces(docs, path, capacity, end, with_ids), "pieces")
    tasks = keep(found.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(solve(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = found.join(tasks.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("before")).drop("task", "local", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value.sort_values(["size", "first"], kind="stable").reset_index(drop=True)
        start = np.searchsorted(table["size"], np.arange(capacity + 2))
        first, base, each, offset = (table[c].to_numpy() for c in ("first", "base", "each", "offset"))
        for frame in frames:
            size, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            at = np.zeros(len(frame), np.int64)
            for s in np.unique(size).tolist():
                here = size == s
                lo, hi = start[s], start[s + 1]
                at[here] = lo + np.searchsorted(first[lo:hi], rank[here], "right") - 1
            behind = rank - first[at]
            yield frame[names].assign(sequence_id=base[at] + behind // each[at], offset=offset[at] + behind % each[at] * size)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return ranked.mapInPandas(placed, f"{schema}, sequence_id long, offset long")
