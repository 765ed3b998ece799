"""Trained operators against plain loops: naive Bayes, the regularised leader, packings against the true optimum."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dockyard.llm import language, packing, quality
from dockyard.llm.tables import tokenizer_path

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_features(text):
    """Hashed one-, two- and three-character n-grams of letters, all else one blank."""
    found, before, earlier, last = [], mixed(0x21), mixed(0x21), None
    for c in text.lower():
        cp = ord(c) if unicodedata.category(c)[0] == "L" else 0x20
        if cp == 0x20 and last == 0x20:
            continue
        one = mixed(cp + 1)
        two = one * 3 + before * 5 & MASK
        found += [one >> 49, mixed(two) >> 49, mixed(two + earlier * 7 & MASK) >> 49]
        before, earlier, last = one, before, cp
    return found


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_naive_bayes_against_a_loop(spark):
    words = {"x": "der und haus zeit mit von über straße", "y": "the and house time with of over street", "z": "la et maison temps avec de sur rue été"}
    turn = np.random.default_rng(3)
    rows = [(n, " ".join(turn.choice(words[lang].split(), 6)) + "!  " * (n % 3), lang) for n, lang in enumerate(turn.choice(list("xyz"), 120).tolist())]
    rows += [(200, None, "x"), (201, "12 3", "y"), (202, "maison street", None), (203, "", "z")]
    counts, documents = defaultdict(Counter), Counter()
    for n, text, lang in rows:
        if text is not None and lang is not None and fold(n, 4) != 2:
            counts[lang].update(plain_features(text))
            documents[lang] += 1
    size, all_documents = 1 << language.BITS, documents.total()
    want = {}
    for n, text, _ in rows:
        sums = {}
        for lang in sorted(counts):
            total = counts[lang].total() + 0.5 * size
            sums[lang] = math.log(documents[lang] / all_documents) + sum(math.log((counts[lang][f] + 0.5) / total) for f in plain_features(text or ""))
        best = max(sorted(sums), key=lambda k: sums[k])
        whole = sum(math.exp(s - sums[best]) for s in sums.values())
        want[n] = (best, 1 / whole) if any(map(str.isalpha, text or "")) else ("und", 0.0)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {n: p for n, (p, _) in found.items()} == {n: p for n, (p, _) in want.items()}
    assert all(abs(found[n][1] - want[n][1]) < 1e-3 for n in want)


def test_the_regularised_leader_against_a_loop(spark):
    """The same examples in the same order, one coordinate at a time."""
    good, bad = "a quiet sentence about rivers and hills number", "BUY!!! now %% cheap cheap cheap $$$ click"
    texts = [(n, f"{good} {n} {n * 7}" if n % 3 else f"{bad} {n}") for n in range(60)] + [(60, ""), (61, None)]
    labels = [(n, int(n % 3 > 0)) for n in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    bias, alpha, beta, l1, l2 = 1 << quality.BITS, 0.2, 1.0, 0.002, 0.02
    rows = []
    for n, text in texts:
        at, x = next(quality.features([(text or "").encode()]))
        rows.append((n, [*zip(at.tolist(), x.astype(np.float32).astype(float).tolist(), strict=True), (bias, 0.5)]))
    z, seen = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(seen[i])) / alpha + l2)

    train = [(row, dict(labels)[n]) for n, row in rows if n < 60 and fold(n, 5)]
    turn = np.random.default_rng(7)
    for _ in range(3):
        for k in turn.permutation(len(train)):
            row, label = train[k]
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row)))
            for i, x in row:
                g = (p - label) * x
                z[i] += g - (math.sqrt(seen[i] + g * g) - math.sqrt(seen[i])) / alpha * w[i]
                seen[i] += g * g
    for n, row in rows:
        assert abs(found[n] - 1 / (1 + math.exp(-sum(weight(i) * x for i, x in row)))) < 1e-3
    assert len(train) < 60 and found[1] > 0.6 > 0.4 > found[0]


def fewest(sizes, capacity):
    """The least number of rooms, by trying every set of sizes that fits beside the largest one left."""

    @cache
    def need(left):
        if not left:
            return 0
        head, rest = left[-1], left[:-1]
        best = len(left)
        for chosen in range(1 << len(rest)):
            inside = [s for k, s in enumerate(rest) if chosen >> k & 1]
            if head + sum(inside) <= capacity:
                best = min(best, 1 + need(tuple(s for k, s in enumerate(rest) if not chosen >> k & 1)))
        return best

    return need(tuple(sorted(sizes)))


@pytest.mark.parametrize("seed", range(6))
def test_fixed_sets_keep_the_optimum(seed):
    """What the reduction fixes, and the best of the rest, is as few as the best of all."""
    turn = np.random.default_rng(seed)
    for _ in range(12):
        capacity = int(turn.integers(8, 30))
        sizes = turn.integers(1, capacity + 1, int(turn.integers(2, 9))).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed, left = packing.reduce(counts.copy(), capacity)
        rest = [s for s in range(1, capacity + 1) for _ in range(int(left[s]))]
        best = fewest(sizes, capacity)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == best
        assert best <= sum(n for _, n in fixed) + sum(n for _, n in packing.best_fit(left, capacity)) <= best + 1


def test_the_pipelines_pieces_are_whole(spark, tmp_path):
    """Each piece's ids, place and checksum, from the texts that the stage before kept."""
    texts = [(n, f"document {n} holds its own words: " + " ".join(f"w{n}_{k}" for k in range(40 * n))) for n in range(1, 9)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {n: [*whole.encode(t, add_special_tokens=False).ids, 2] for n, t in texts}
    rows = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    done, ends = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["start"] == len(done[r["doc_id"]]) and r["piece"] == sum(x["doc_id"] == r["doc_id"] and x["piece"] < r["piece"] for x in rows)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        done[r["doc_id"]] += part
    assert done == ids and max(map(len, ids.values())) > 1024
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(ends.values()) // 1024) + 1
