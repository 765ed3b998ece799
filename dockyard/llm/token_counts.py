"""Token counts by map-side lookup in two tiers.

A text's tokens are the sum of its pre-tokens' tokens. A first pass gives each task's most frequent pre-tokens; their
counts are added up, and the lengths of the most frequent ones are broadcast as a compact hash table. Counting then
looks each pre-token up there; misses go to a cache in the worker, and what the cache lacks is encoded once. No
pre-token is shuffled, but for the bounded summaries of the first pass. The table only saves work: what it holds
changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.llm.pretokens import Block, Cache, blocks, same_bytes
from dockyard.llm.tables import vocabulary
from dockyard.llm.words import hash_spans

#: Entries of the broadcast table (12 bytes each), and of each task's summary.
TABLE = 1 << 15
SUMMARY = 1 << 14
LONGEST = 64  # bytes of a pre-token that the table takes
LIMIT = 4096

BLANKS = (0x20, 0x2581)  # the blank and the sign that stands for it in pieces


class PieceModel:
    """A sentencepiece BPE model that escapes blanks and adds one before each text."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # Cutting before a run of blanks is exact only where no piece holds a blank behind anything else.
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode("a  b ", out_type=str) != [*self.model.encode("a", out_type=str), "▁", "▁b", "▁"]:
            raise ValueError("a model is needed whose pieces don't cross blanks and which keeps all blanks")

    def lengths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word starts with a blank, which the model adds itself."""
        texts = [w.decode()[1:] for w in words]
        coded = self.model.encode(texts, num_threads=1)
        found = np.fromiter((len(c) if t else 1 for t, c in zip(texts, coded, strict=True)), np.int64, len(words))
        return found, np.ones(len(words), np.int64)


def word_starts(block: Block) -> np.ndarray:
    """Where pre-tokens begin: at each run of blanks; every text given begins with one."""
    blank = (block.cps == BLANKS[0]) | (block.cps == BLANKS[1])
    start = block.first()
    start[1:] |= blank[1:] & ~blank[:-1]
    return start


def _blocks(texts: list[str]):
    """Blocks of the texts with the blank that the model adds; empty texts have no tokens and no blank."""
    return blocks([f" {t}" if t else "" for t in texts])


def frequent(docs: DataFrame, model: PieceModel, size: int = TABLE, summary: int = SUMMARY) -> tuple[np.ndarray, ...]:
    """The most frequent pre-tokens of all texts by their codes: codes, token counts, their bytes, and where each one's begin and end."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[bytes, int] = {}
        for frame in frames:
            for _, block, _ in _blocks(frame["text"].tolist()):
                codes, lo, hi, _ = block.pieces(word_starts(block))
                codes, at, counts = np.unique(codes, return_index=True, return_counts=True)
                best = np.argsort(-counts, kind="stable")[:summary]
                raw = block.data.tobytes()
                for a, b, n in zip(lo[at[best]].tolist(), hi[at[best]].tolist(), counts[best].tolist(), strict=True):
                    if b - a <= LONGEST:
                        words[raw[a:b]] = words.get(raw[a:b], 0) + n
                if len(words) > 8 * summary:
                    words = dict(sorted(words.items(), key=lambda x: -x[1])[: 2 * summary])
        top = sorted(words.items(), key=lambda x: -x[1])[:summary]
        yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top]}, columns=["word", "n"]).astype({"n": "int64"})

    found = docs.mapInPandas(local, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    words = [bytes(r["word"]) for r in found.collect()]
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, _ = model.lengths(words)
    raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = np.append(0, ends[:-1])
    codes = hash_spans(raw, starts, ends)
    # Of words with one code the first counts; the others are looked up as words that the table lacks.
    codes, order = np.unique(codes, return_index=True)
    return codes, sizes[order].astype(np.int32), raw, starts[order], ends[order]


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty: 0 bytes, 0 tokens. Very long texts are counted whole. Special strings are counted as the model's library does by default. Rows
    repeated whole get the same counts; other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = vocabulary(spark, path)
    source = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(frequent(source.select("text"), PieceModel(held.value)))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sizes, raw, first_byte, last_byte = table.value
        cache = Cache(PieceModel(held.value).lengths)
        for frame in frames:
            totals = np.zeros(len(frame), np.int64)
            for first, block, texts in _blocks(frame["text"].tolist()):
                codes, lo, hi, bounds = block.pieces(word_starts(block))
                tokens = np.zeros(len(codes), np.int64)
                miss = np.ones(len(codes), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    miss = known[at] != codes
                    hit = np.flatnonzero(~miss)
                    word = at[hit]
                    miss[hit] = ~same_bytes(block.data, lo[hit], hi[hit], raw, first_byte[word], last_byte[word])
                    tokens = np.where(miss, 0, sizes[at]).astype(np.int64)
                if miss.any():
                    rows = cache.look(block.data, codes[miss], lo[miss], hi[miss])
                    tokens[miss] = cache.flat[rows]
                ends = np.concatenate(([0], np.cumsum(tokens)))
                totals[first : first + len(texts)] = ends[bounds[1:]] - ends[bounds[:-1]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "n_tokens": totals, "over_limit": totals > limit})

    kind = dict(source.dtypes)["doc_id"]
    rows = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(made, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
