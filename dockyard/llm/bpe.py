"""Byte-level BPE encoding and decoding by merge replay over a corpus block's distinct pre-tokens.

A task collects the distinct pre-tokens of its texts and encodes all of them at once: an inverted index from
token pair to positions is built once, and merges are applied in rank order, each to all of its positions, looking anew
only at the neighbours it touches. Texts are put together from their pre-tokens' ids; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.llm.pretokens import Cache, blocks, byte_level_starts, gather
from dockyard.llm.tables import vocabulary

_NEVER = np.int64(1 << 40)


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks as in a rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class MergeReplay:
    """Encodes pre-tokens by the ranks of byte strings, as repeatedly merging the first pair of lowest rank does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.codes = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        parts = sorted((rank, token) for token, rank in ranks.items())
        sizes = np.zeros(self.width, np.int64)
        sizes[[r for r, _ in parts]] = [len(t) for _, t in parts]
        self.token_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.token_bytes = np.frombuffer(b"".join(t for _, t in parts), np.uint8)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank to which each pair merges, _NEVER where it doesn't."""
        code = a * self.width + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.found[at], _NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        token = self.bytes_rank[data]
        # Position n stands for "nothing"; next and before are positions of living tokens of the same word.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[ends[:-1]] = n
        before[0] = n
        after[n] = n
        token = np.append(token, -1)
        rank = np.full(n + 1, _NEVER)
        inner = np.flatnonzero(after[:n] != n)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        # The inverted index: positions by rank of the pair that starts there.
        by_rank = inner[np.argsort(rank[inner], kind="stable")]
        values, cuts = np.unique(rank[by_rank], return_index=True)
        cuts = np.append(cuts, len(by_rank))
        index = {int(v): [by_rank[cuts[i] : cuts[i + 1]]] for i, v in enumerate(values.tolist()) if v != _NEVER}
        heap = list(index)
        heapq.heapify(heap)
        alive = np.ones(n + 1, bool)
        odd: set[int] = set()  # words in which a merge made a pair of lower rank: their order of merges is looked at one by one
        while heap:
            now = heapq.heappop(heap)
            lists = index.pop(now, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == now]
            if not len(at):
                continue
            right = after[at]
            if (right[:-1] == at[1:]).any():  # a pair of equal tokens in a run: every other one
                taken, free = [], -1
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    if p != free:
                        taken.append(p)
                        free = q
                at = np.array(taken)
                right = after[at]
            token[at] = now
            behind = after[right]
            after[at] = behind
            before[behind] = at
            before[n] = n
            alive[right] = False
            rank[right] = _NEVER
            front = before[at]
            # Only the neighbours are looked at anew.
            rank[at] = np.where(behind != n, self.pair_ranks(token[at], token[behind]), _NEVER)
            held = front != n
            front = front[held]
            rank[front] = self.pair_ranks(token[front], token[after[front]])
            for touched in (at, front):
                made = rank[touched]
                fits = made != _NEVER
                touched, made = touched[fits], made[fits]
                if not len(touched):
                    continue
                if (low := made < now).any():
                    odd.update(owner[touched[low]].tolist())
                order = np.argsort(made, kind="stable")  # positions stay in order within a rank
                touched, made = touched[order], made[order]
                cuts = [0, *(np.flatnonzero(made[1:] != made[:-1]) + 1).tolist(), len(made)]
                for key, lo, hi in zip(made[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                    if key in index:
                        index[key].append(touched[lo:hi])
                    else:
                        index[key] = [touched[lo:hi]]
                        heapq.heappush(heap, key)
        alive[n] = False
        left = np.flatnonzero(alive)
        ids, counts = token[left], np.bincount(owner[left], minlength=len(words))
        if odd:
            starts = np.concatenate(([0], np.cumsum(counts)))
            parts = [ids[starts[w] : starts[w + 1]] if w not in odd else self.encode_one(words[w]) for w in range(len(words))]
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts

    def encode_one(self, word: bytes) -> np.ndarray:
        """One word, merge by merge."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], int(_NEVER)), i) for i in range(len(parts) - 1))
            if best == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return np.array([self.ranks[p] for p in parts], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_starts, ids)[0].tobytes()


def encoded(texts: list[str], cache: Cache) -> Iterator[np.ndarray]:
    """The ids of each text, by the byte-level pattern and the cache's encoder."""
    for _, block, held in blocks(texts):
        codes, lo, hi, bounds = block.pieces(byte_level_starts(block))
        ids, ends = cache.expand(cache.look(block.data, codes, lo, hi))
        for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
            yield ids[a:b]


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens and ids (array<long>), or with ``digests`` ids_sha256 and decoded_sha256 instead of ids.

    Null texts count as empty: no ids, and decoded to no bytes. Special strings are ordinary text. Rows repeated whole get
    the same answer; other columns aren't read; an empty table gives no rows.
    """
    held = vocabulary(docs.sparkSession, path)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = MergeReplay(load_ranks(held.value))
        cache = Cache(replay.encode)
        for frame in frames:
            texts, found = frame["text"].tolist(), []
            for ids in encoded(texts, cache):
                if digests:
                    found.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(replay.decode(ids)).hexdigest()))
                else:
                    found.append((len(ids), ids.tolist()))
            out = pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    source = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>")
    return source.mapInPandas(made, schema)


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null, and bytes that aren't UTF-8 are replaced."""
    held = vocabulary(encoded_docs.sparkSession, path)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = MergeReplay(load_ranks(held.value))
        for frame in frames:
            texts = [None if ids is None else replay.decode(np.asarray(ids, np.int64)).decode(errors="replace") for ids in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    kind = dict(encoded_docs.dtypes)["doc_id"]
    return encoded_docs.select("doc_id", "ids").mapInPandas(made, f"doc_id {kind}, text string")
