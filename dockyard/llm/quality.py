"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A token is a run of letters and digits or a run of other visible characters, so marks glued to words are tokens of
their own; case is kept. A text's features are its hashed token unigrams and bigrams, and for each token and each
bigram its shape (case, length class, mark) and whether a token repeats the one before it. Each feature
counts by its share of the text. Scores are sparse dot products, summed per text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.llm.tables import fold, fresh
from dockyard.llm.words import blocks, hash_spans, mix

#: log2 of the number of hashed features, and the most labelled rows that are learned from (the documented bound).
BITS = 18
SAMPLE = 6000
FOLDS = 5
CUT = 0.3

# Classes of bytes: 0 blank, 1 letter or digit (bytes of other alphabets included), 2 mark.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x00, 0x21), 0x7F]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def features(raws: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text of a block: feature numbers (distinct, sorted) and their weights."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    kind = _KIND[data]
    turn = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
    starts, ends = turn[:-1], turn[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    if not len(starts):
        # A block without a token: every text in it has no features.
        yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in raws)
        return
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    # A text's first token stands beside itself, whatever text lies before it in the block.
    behind = np.maximum(np.arange(len(starts)) - 1, 0)
    borders = bounds[:-1][bounds[:-1] < bounds[1:]]
    behind[borders] = borders
    codes = hash_spans(data, starts, ends)
    n = ends - starts
    caps = np.concatenate(([0], np.cumsum(_UPPER[data])))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    upper = caps[ends] - caps[starts]
    case = np.where(upper == 0, 0, np.where(upper == n, 2, 1)) * 2 + (digits[ends] > digits[starts])
    mark = kind[starts] == 2
    glued = np.concatenate(([False], starts[1:] == ends[:-1]))
    shape = np.where(mark, 64 + np.minimum(n, 7) * 2 + glued, case * 8 + np.minimum(n // 3, 7)).astype(np.uint64)
    again = codes == codes[behind]
    again[borders] = False
    again = again.astype(np.uint64)
    tag = lambda x, k: mix(x * np.uint64(8) + np.uint64(k))
    before = codes[behind] * np.uint64(3)
    shape_before = shape[behind]
    rows = np.stack((tag(codes, 0), mix(codes + before), tag(shape, 2), tag(shape * np.uint64(1024) + shape_before, 3), tag(again, 4)))
    rows = (rows >> np.uint64(64 - bits)).astype(np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if lo == hi:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        found, counts = np.unique(rows[:, lo:hi], return_counts=True)
        weights = np.sqrt(counts / (hi - lo))
        yield found, weights


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights (2**bits features, then the bias), learned from at most ``sample`` labelled rows outside the held-out fold.

    The rows are the first by a hash of doc_id, the same share of each label as far as it reaches. Null labels and
    ids are not learned from; a doc_id with several labels counts as labelled by the largest. Without rows all
    weights are 0 (every score is 0.5).
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.where(fold(F.col("id"), FOLDS) != 0).groupBy("id").agg(F.max("label").alias("label"))
    chosen = marked.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    chosen = chosen.unionByName(marked.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample - sample // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [x for _, raws in blocks(frame["text"].tolist()) for x in features(raws, bits)]
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "at": [a.astype(np.int32).tobytes() for a, _ in rows], "x": [x.astype(np.float32).tobytes() for _, x in rows]})

    # At most ``sample`` ids: a bounded table, whatever the input is. Its features come to the driver.
    found = texts.join(F.broadcast(chosen), "id").mapInPandas(made, "id long, label int, at binary, x binary").toPandas()
    found = found.drop_duplicates("id").sort_values("id", kind="stable")
    model = Ftrl((1 << bits) + 1)
    rows = [(np.append(np.frombuffer(a, np.int32), 1 << bits), np.append(np.frombuffer(x, np.float32), 0.5).astype(float), int(y)) for a, x, y in zip(found["at"], found["x"], found["label"], strict=True)]
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turn.permutation(len(rows)):
            model.update(*rows[i])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(id, score) and all columns of ``docs`` beside them are not needed: give (id, text, ...) and get text replaced by score."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    others = [c for c in docs.columns if c != "text"]

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = held.value
        for frame in frames:
            sums = [float(w[at] @ x) for _, raws in blocks(frame["text"].tolist()) for at, x in features(raws, bits)]
            logit = np.clip(np.array(sums, float) + 0.5 * float(w[-1]), -35, 35)
            yield frame[others].assign(score=1 / (1 + np.exp(-logit)))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInPandas(made, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, key.

    Null texts count as empty and get the bias's score. A null doc_id is in no fold (held_out false). Rows repeated
    whole get the same score, very long texts one over all their words. A score of exactly CUT is predicted 1. An empty table gives no rows.
    Only doc_id and text are read.
    """
    weights = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return score(rows, weights).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns and repeated rows included, that the classifier doesn't reject.

    A score of exactly CUT stays, as do null and empty texts where the bias's score does; very long texts are scored whole, and an empty
    table stays empty. The score is added to each row in the task that reads it, so no text is shuffled.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels).astype(np.float32))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = weights.value
        for batch in texts:
            sums = [float(w[at] @ x) for _, raws in blocks(batch.tolist()) for at, x in features(raws)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float) + 0.5 * float(w[-1]), -35, 35))), dtype=float)

    name = fresh(docs, "quality_score")
    return docs.withColumn(name, scored(F.coalesce(F.col("text"), F.lit("")))).where(F.col(name) >= CUT).drop(name)
