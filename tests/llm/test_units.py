"""The operators' parts without Spark."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from dockyard.llm import bpe, embeddings, packing, quality, secrets
from dockyard.llm.exact_dedup import CuckooFilter, Shard
from dockyard.llm.ngram_jaccard import COLUMN, Ratio, _columns
from dockyard.llm.pretokens import Cache
from dockyard.llm.words import blocks, shingle_sets, word_codes


def test_cuckoo_filter_grows_from_stored_keys_and_forgets_what_is_deleted():
    turn = random.Random(1)
    shard = Shard([])
    keys = [turn.randbytes(32) for _ in range(3000)]
    for n, k in enumerate(keys):
        shard.insert(k, 1, n, n)
    assert shard.filter.mask + 1 >= 3000 / 4 and all(k in shard.filter for k in keys)
    for k in keys[:1500]:
        shard.delete(k)
    again = Shard(shard.rows())
    assert set(again.content) == set(keys[1500:]) and all(k in again.filter for k in keys[1500:])
    assert sum(k in again.filter for k in keys[:1500]) < 30
    again.insert(keys[1600], 2, 5, 9)
    assert again.content[keys[1600]] == [3, 1600, 1600]
    # Nine copies of one digest have no place in the eight slots of its two buckets: the filter says so.
    crowd = CuckooFilter(8)
    assert not all(crowd.insert(b"\0" * 32) for _ in range(9))


def test_codes_are_the_same_wherever_the_words_stand():
    one, _ = word_codes([b"Some words here", b"", b"here"])
    two, _ = word_codes([b"x" * 5000 + b" some\x0bWORDS \r here"])
    assert one[:3].tolist() == two[1:].tolist() and one[3] == one[2]


def test_shingle_sets_equal_sets_of_words():
    turn = random.Random(2)
    texts = [" ".join(turn.choice("abc") for _ in range(turn.randrange(0, 30))) for _ in range(200)]
    sets = [s for _, raws in blocks(texts, 50) for s in shingle_sets(raws)]
    plain = []
    for t in texts:
        w = t.split()
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(0, 200, 7):
        for j in range(0, 200, 11):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_columns_give_all_pairs_that_can_match_or_chain_large_columns(batch):
    import pandas as pd

    turn = random.Random(3)
    rows = sorted((g, c, turn.randrange(8, 12)) for g in range(40) for c in turn.sample(range(100), turn.randrange(1, 12)))
    rows += [(99, c, 10) for c in range(COLUMN + 5)] + [(100, 1, 10), (100, 2, 10)]
    frame = pd.DataFrame(sorted(rows + rows[::3] + rows[::4]), columns=["gram", "cls", "n"])  # several tasks may send an entry
    found = pd.concat(_columns(Ratio())(frame[i : i + batch] for i in range(0, len(frame), batch)))
    pairs = sorted(map(tuple, found[found.na >= 0][["a", "b", "na", "nb"]].to_numpy().tolist()))
    want = [(c, d, n, m) for g, c, n in rows for h, d, m in rows if g == h != 99 and c < d and 100 * min(n, m) >= 80 * max(n, m)]
    assert pairs == sorted(want)
    assert set(found[found.na < 0]["b"]) | {0} == set(range(COLUMN + 5))


def test_merge_replay_equals_the_library_on_odd_texts():
    blob = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    replay = bpe.MergeReplay(bpe.load_ranks(blob))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    turn, signs = random.Random(4), "ab 'stmdlre\n\t é漢字12½!?.  　\U0001f600<|>aaaa\x1c\x85ſ"
    texts = ["".join(turn.choice(signs) for _ in range(turn.randrange(60))) for _ in range(3000)] + ["aaaaaaa", "'s's", ""]
    for text, ids in zip(texts, bpe.encoded(texts, Cache(replay.encode, most=500)), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)
        assert replay.decode(ids) == text.encode()


def test_replay_looks_again_at_words_whose_merges_make_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abca": 257, b"ab": 258, b"ca": 259, b"abc": 260}
    replay, turn = bpe.MergeReplay(ranks), random.Random(5)
    words = [bytes(turn.choice(b"abc") for _ in range(turn.randrange(1, 12))) for _ in range(500)]
    ids, counts = replay.encode(words)
    ends = np.cumsum(counts)
    for word, lo, hi in zip(words, ends - counts, ends, strict=True):
        assert ids[lo:hi].tolist() == replay.encode_one(word).tolist()


def test_packing_places_everything_and_never_needs_more_than_best_fit_decreasing():
    turn = np.random.default_rng(6)
    for _ in range(150):
        capacity = int(turn.integers(5, 60))
        counts = np.bincount(turn.integers(1, capacity + 1, int(turn.integers(1, 60))), minlength=capacity + 1)
        rooms = []
        for size in (s for s in range(capacity, 0, -1) for _ in range(counts[s])):
            fits = [i for i, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= size
            else:
                rooms.append(capacity - size)
        assert sum(n for _, n in packing.best_fit(counts, capacity)) == len(rooms)
        fixed, left = packing.reduce(counts, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert sum(n for _, n in fixed) + sum(n for _, n in packing.best_fit(left, capacity)) <= len(rooms)
        packing.solve(counts, capacity)


def test_trigram_queries_hold_for_matches_of_their_rules():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") == secrets.TRUE
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert secrets.trigram_query("ab(c|d)e?f") == {frozenset({"abc", "bce", "cef"}), frozenset({"abc", "bcf"}), frozenset({"abd", "bde", "def"}), frozenset({"abd", "bdf"})}
    for text in ("API_KEY='abcdefghijkl'", "apikey:abcdefghijklm", "PASSWD=abcdefghijkl", "Secret = abcdefghijkl"):
        rule = secrets.RULES[0]
        assert re.search(rule.pattern, text)
        assert any(all(g in text.lower() for g in need) for need in secrets.trigram_query(rule.pattern))


def test_collision_counts_equal_plain_windows_and_calibration_keeps_pairs():
    turn = np.random.default_rng(8)
    left, right = turn.standard_normal((30, 9)), turn.standard_normal((40, 9))
    plain = (np.abs(left[:, None] - right[None]) <= 0.4).sum(axis=2)
    assert (embeddings.collisions(left, right, 0.4) == plain).all()
    half, least = embeddings.calibrated(64)
    assert 0 < least < embeddings.PROJECTIONS and half > 0


def test_ftrl_separates_two_kinds():
    raws = [b"plain words in a row", b"SHOUT!! SHOUT!! SHOUT!!"] * 40
    rows = list(quality.features(raws))
    model = quality.Ftrl((1 << quality.BITS) + 1)
    for n, (at, x) in enumerate(rows):
        model.update(at, x, (n + 1) % 2)
    w = model.weights()
    assert w[rows[0][0]] @ rows[0][1] > 0 > w[rows[1][0]] @ rows[1][1]
