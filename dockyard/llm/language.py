"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters counts as one blank. Each position gives a one-, two- and three-character
n-gram, hashed to 2**BITS features. Training adds up counts per language in the tasks and then by feature. The matrix of
log-probabilities (languages x features) is broadcast in groups of at most MOST_LANGUAGES, one group after the other, and texts are
scored in blocks; a row keeps its best language so far, that one's sum and the log of all sums' total.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.llm.pretokens import LETTER, Block, blocks, char_classes
from dockyard.llm.tables import fold, keep
from dockyard.llm.words import mix

BITS = 15
FOLDS, HELD_OUT = 4, 2
ORDERS = 3
#: A broadcast matrix has at most this many languages (256 KB each at 15 bits); more are scored in several passes.
MOST_LANGUAGES = 400


def features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, one row per order, of each position that isn't a blank after a blank, and where texts begin among them."""
    kind = char_classes()[block.cps]
    first = block.first()
    cps = np.where(kind == LETTER, block.cps, 0x20).astype(np.uint64)
    blank = cps == 0x20
    stay = ~blank | first
    stay[1:] |= ~blank[:-1]
    places = np.flatnonzero(stay)
    bounds = np.searchsorted(places, block.borders)
    cps, first = cps[places], first[places]
    one = mix(cps + np.uint64(1))
    before = np.concatenate((one[:1], one[:-1]))
    blank_code = mix(np.array([0x21], np.uint64))[0]
    before[first] = blank_code
    earlier = np.concatenate((before[:1], before[:-1]))
    earlier[first] = blank_code
    two = one * np.uint64(3) + before * np.uint64(5)
    three = two + earlier * np.uint64(7)
    rows = np.stack((one, mix(two), mix(three)))
    return (rows >> np.uint64(64 - bits)).astype(np.int64), bounds


def train(docs: DataFrame, bits: int = BITS, most: int = MOST_LANGUAGES) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """Languages (sorted), at most ``most`` at once, and their matrix: a row of log-probabilities per feature, and the log prior last;
    and whether they are the last languages.

    Learns from all rows with text, lang and doc_id whose fold isn't the held-out one.
    """
    rows = docs.where("text is not null and lang is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = rows.select("lang", F.lower("text").alias("text"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "at": at, "n": counts[at]})
            held.clear()

        for frame in frames:
            for lang, group in frame.groupby("lang", sort=False):
                if lang not in held and len(held) >= most:
                    yield from flushed()
                counts = held.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                for _, block, texts in blocks(group["text"].tolist()):
                    at, _ = features(block, bits)
                    counts[:-1] += np.bincount(at.ravel(), minlength=1 << bits)
                    counts[-1] += len(texts)
        yield from flushed()

    found = keep(rows.mapInPandas(counted, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")), "languages")
    names = sorted(r["lang"] for r in found.select("lang").distinct().collect())
    documents = found.where(F.col("at") == 1 << bits).agg(F.sum("n")).first()[0]
    for lo in range(0, len(names), most):
        languages = names[lo : lo + most]
        group = docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int")
        part = found.join(F.broadcast(group), "lang").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("counts"))
        counts = np.zeros((len(languages), (1 << bits) + 1))
        for row in part.collect():
            counts[row["number"], [x["at"] for x in row["counts"]]] = [x["n"] for x in row["counts"]]
        grams = counts[:, :-1] + 0.5
        logs = np.log(grams / grams.sum(axis=1, keepdims=True))
        yield languages, np.hstack((logs, np.log(counts[:, -1:] / documents))).T.astype(np.float32).copy(), lo + most >= len(names)


def _scored(rows: DataFrame, languages: list[str], matrix: np.ndarray, bits: int, last: bool) -> DataFrame:
    """``rows`` with the best language so far (best), its sum (top) and the log of the total of all exponentials (whole); ``last`` leaves the text out."""
    model = rows.sparkSession.sparkContext.broadcast((languages, matrix))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, logs = model.value
        for frame in frames:
            texts = frame["text"].tolist()
            sums = np.zeros((len(texts), len(names)))
            # A block's sums take 8 bytes per position and language.
            for first, block, held in blocks(texts, max(1 << 14, (1 << 23) // max(4, len(names)))):
                at, bounds = features(block, bits)
                for order in at:
                    # A sparse product: the rows of the features that occur, added up between the texts' borders.
                    ends = np.concatenate((np.zeros((1, len(names))), np.cumsum(logs[order], axis=0, dtype=np.float64)))
                    sums[first : first + len(held)] += ends[bounds[1:]] - ends[bounds[:-1]]
            if len(texts):
                sums += logs[-1]
                best, top = sums.argmax(axis=1), sums.max(axis=1)
                before = frame["top"].to_numpy(float)
                # Languages come in order of their names, so of equal sums the earlier one stays.
                frame["best"] = [names[b] if new else old for b, new, old in zip(best, top > before, frame["best"], strict=True)]
                frame["top"] = np.maximum(top, before)
                frame["whole"] = np.logaddexp(frame["whole"].to_numpy(float), top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
            frame["worded"] = [any(map(str.isalpha, t)) for t in texts]
            yield frame.drop(columns="text") if last else frame

    return rows.mapInPandas(made, (rows.drop("text") if last else rows).schema)


def predict(docs: DataFrame, parts: Iterable[tuple[list[str], np.ndarray, bool]], bits: int = BITS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the posterior of lang_pred)."""
    low = F.lit(float("-inf"))
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    rows = rows.select("*", F.lit(None).cast("string").alias("best"), low.alias("top"), low.alias("whole"), F.lit(False).alias("worded"))
    for languages, matrix, last in parts:
        rows = _scored(rows, languages, matrix, bits, last)
        if not last:
            rows = keep(rows, "scored")  # so that one matrix is held at a time

    # In SQL: another Python function would be another process beside each task's.
    found = F.col("best").isNotNull() & F.col("worded")
    return rows.select(
        "doc_id", "held_out", F.when(found, F.col("best")).otherwise("und").alias("lang_pred"), F.when(found, F.exp(F.col("top") - F.col("whole"))).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, most: int = MOST_LANGUAGES) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter give ``und`` with score 0, and so does everything where nothing can be learned.
    A null doc_id is in no fold and not learned from. Of equal scores the first language by name wins. Rows repeated whole count
    in training as often as they occur and get the same answer each; very long texts are counted and scored whole. An empty table gives
    no rows. Only doc_id, text and, for training, lang are read.
    """
    return predict(docs, train(docs, most=most))
