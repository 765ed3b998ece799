"""Host rules, the Merkle manifest and the divergence audit on odd tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

import oracle
from dockyard.llm import divergence, host_rules, merkle
from dockyard.llm.oracles import ORACLES
from dockyard.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i + 65: i + 97 for i in range(26)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, g string, term string, kept string, row long, digest string"


def odd_rows():
    long = " ".join(f"Word{i % 331} und" for i in range(30000))
    junk = "## $$ %% one two three four five six seven eight ** && <>"
    texts = [
        (1, "a b c d e a b c d e a", "https://www.Example.org/x"), (2, "a b c d e f g h i j a b c d e", "http://user@example.org:80"),
        (3, None, None), (4, "", ""), (5, " \n\n \t", "src"), (5, "x x x x x x x x x x x", "src"), (5, "x x x x x x x x x x x", "src"), (None, "Été été ÉTÉ the the", "Src"),
        (None, None, "src"), (6, "line\nline\n\nline\r\nother 漢字 漢字\n", "src"), (7, long, "a.example/b?c"), (8, long + "\n" + long, "a.example"), (9, junk, "junk.example"),
        (10, junk + "\nthe the", "junk.example/2"), (11, "\n".join([junk] * 9), "junk.example"), (12, "the été " * 12, "junk.example"), (13, "clean prose of more than ten words that nobody should ever lose", "junk.example"),
    ] + [(50 + n, f"{junk} item {n}", "junk.example/more") for n in range(30)] + [(100 + n, f"the quick brown fox number {n} jumps over some lazy dog and été runs", f"site{n % 4}.example") for n in range(40)]
    return [(i, t, ("en", "fr", None)[n % 3], s, None if t is None else len(t), "h", "g", "t", "k", 7, "d") for n, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def plain_host(source):
    found = re.match(host_rules.HOST, (source or "").translate(LOWER))
    return found.group(1) if found else None


def test_host_rules_against_plain_python(odd):
    rows = odd_rows()
    flags = []
    for r in rows:
        w, c, s, d, p, n = plain_counts(r[1])
        flags.append({"short": w < 10, "repeats": 100 * p > 20 * w, "symbols": 10 * s > w, "dup_lines": 10 * d > 3 * n, "word_size": c < 2 * w or c > 15 * w})
    hosts = defaultdict(list)
    for r, f in zip(rows, flags, strict=True):
        if plain_host(r[3]):
            hosts[plain_host(r[3])].append(f)
    bad = set()
    for rule in host_rules.RULES:
        rates = [10**6 * sum(f[rule] for f in x) // len(x) for x in hosts.values()]
        mean = sum(rates) / (len(rates) * 10**6)
        spread = sum(x * x for x in rates) / (len(rates) * 10**6) / 10**6 - mean * mean
        weight = min(max(mean * (1 - mean) / spread - 1, host_rules.WEAKEST), host_rules.STRONGEST) if spread > 0 else host_rules.STRONGEST
        bad |= {h for h, x in hosts.items() if (sum(f[rule] for f in x) + mean * weight) / (len(x) + weight) > 0.5}
    assert bad and len(bad) < len(hosts) and "site1.example" not in bad and "junk.example" in bad
    want = Counter()
    for r, f in zip(rows, flags, strict=True):
        base = f["short"] or f["repeats"]
        want[r[0], plain_counts(r[1])[:5], base, not base and plain_host(r[3]) not in bad, plain_host(r[3])] += 1
    got = Counter((x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words), x.base_failed, x.kept, x.host) for x in host_rules.judge(odd).collect())
    assert got == want


def test_accepted_keeps_rows_and_columns(odd, nothing):
    kept = host_rules.accepted(odd)
    assert kept.columns == odd.columns
    verdicts = host_rules.judge(odd).where("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdicts.collect())
    assert host_rules.judge(nothing).count() == 0 and host_rules.accepted(nothing).count() == 0


def test_a_small_host_is_shrunk_towards_the_others(spark):
    """One bad document of one is no verdict among clean hosts; forty of forty are."""
    bad, good = "# $ % & | < > * # $ % & | < >", "some clean words stand here in a row for the reader to enjoy"
    rows = [(n, good + f" {n}", f"s{n % 20}") for n in range(400)] + [(1000, bad, "lone")] + [(2000 + n, bad, "many") for n in range(40)]
    found = {r.host: r.host_failed for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found["many"] and not found["lone"] and not found["s1"]


def test_windows_are_compared_behind_equal_hashes(spark, monkeypatch):
    """With a hash of no use at all, the exact comparison alone decides."""
    monkeypatch.setattr(host_rules.F, "shiftright", lambda c, n: F.lit(0).cast("long"), raising=True)
    texts = ["a b c d e f g h i j k", "a b c d e f a b c d e", "a b c d e f g a b c d x", "q " * 9]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc_id: r.n_repeat_words for r in host_rules.document_counts(df).select("doc_id", "n_repeat_words").collect()}
    assert found == {i: plain_counts(t)[4] for i, t in enumerate(texts)}


def test_host_counts_need_neither_python_nor_a_shuffle(spark, data_dir):
    plan = host_rules.document_counts(spark.read.parquet(f"{data_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert all(x not in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def plain_tree(nodes):
    """The root and each node's witness, level by level over whole lists."""
    owners, witnesses = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in owners[a + k]:
                    witnesses[i].append((k, "".join(run[:k] + run[k + 1 :])))
            up.append(sha("".join(run)))
            above.append(sum(owners[a : a + 3], []))
        nodes, owners = up, above
    return nodes[0], witnesses


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_plain_python(odd, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = odd_rows()
    sources = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        claimed = r[1] if r[1] is None or not hit else r[1].replace("\n", "")
        sources[r[3]].append((r[0], leaf(r, r[1]), leaf(r, claimed)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in sources[s]]) for s in names}
    root, over = plain_tree([trees[s][0] for s in names])
    want = Counter()
    for number, s in enumerate(names):
        for (doc_id, own, claimed), witness in zip(sources[s], trees[s][1], strict=True):
            proof = witness + over[number]
            folded = claimed
            for k, siblings in proof:
                folded = sha(siblings[: 64 * k] + folded + siblings[64 * k :])
            want[doc_id, own, trees[s][0], root, sha("".join(x for _, x in proof)), folded, folded == root] += 1
    assert Counter(map(tuple, merkle.audit(odd).collect())) == want
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_nothing_and_of_one(spark, nothing, odd):
    assert merkle.audit(nothing).count() == 0
    one = merkle.prove(odd.where("doc_id = 1")).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded, r.proof, r.path) for r in one] == [(True, "", "")]


@given(st.integers(1, 200), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_appended_blocks_give_the_tree_of_the_whole(n, levels):
    """Block roots appended to the next round's subtrees end in the root, and witnesses in order lead there."""
    nodes = [sha(str(i)) for i in range(n)]
    root, witnesses = plain_tree(list(nodes))
    tree = merkle.Subtrees()
    for x in nodes:
        tree.append(x)
    assert tree.finish(merkle.depth(n)) == root and tree.witnesses == witnesses
    assert all(merkle.fold(x, w) == root for x, w in zip(nodes, tree.witnesses, strict=True))
    width, now, size = 3**levels, nodes, n
    while size > 1:
        up = []
        for a in range(0, len(now), width):
            part = merkle.Subtrees()
            for x in now[a : a + width]:
                part.append(x)
            up.append(part.finish(min(levels, merkle.depth(size))))
        now, size = up, -(-size // width)
    assert now == [root]


def plain_divergence(rows, least=3, top=200):
    counts, docs_of, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        words = [w.translate(LOWER) for w in TERM.findall(r[1] or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs_of[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs_of[lang].items() if n >= least]

        def shares(count):
            whole = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("sources,entries,shard,top", [(256, 1 << 18, 1 << 24, 200), (3, 40, 100, 2)])
def test_divergence_against_plain_python(odd, monkeypatch, sources, entries, shard, top):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard)
    monkeypatch.setattr(divergence, "SPREAD", 7)
    got = Counter(map(tuple, divergence.divergence(odd, 3, top).collect()))
    want = plain_divergence(odd_rows(), 3, top)
    assert got == want and any(x[2] == "term" for x in want)


def test_divergence_of_nothing_and_without_words(spark, nothing):
    assert divergence.divergence(nothing).count() == 0
    df = spark.createDataFrame([("", None, "a"), (None, None, "b"), ("1 2 3", None, "c")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence(df).collect())) == [
        ("", "a", "pair", "b", 0, 1), ("", "a", "pair", "c", 0, 2), ("", "b", "pair", "a", 0, 1), ("", "b", "pair", "c", 0, 2), ("", "c", "pair", "a", 0, 1), ("", "c", "pair", "b", 0, 2),
    ]


@given(st.lists(st.text("aAbBzé漢. \n", max_size=60), max_size=12), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_pointer_sort_counts_words(texts, stretch):
    texts = [t.replace("z", "abcdefgh" * stretch) + "\n" for t in texts]
    groups = np.sort(np.arange(len(texts)) % 3)
    words, group, n, docs = divergence.shard_counts(pa.array(texts, pa.string()), groups)
    found = list(zip(words.to_pylist(), group.tolist(), n.tolist(), docs.tolist(), strict=True))
    seen, held = Counter(), Counter()
    for g, t in zip(groups.tolist(), texts, strict=True):
        terms = [w.translate(LOWER) for w in TERM.findall(t)]
        seen.update((w, g) for w in terms)
        held.update((w, g) for w in set(terms))
    assert found == [(w, g, seen[w, g], held[w, g]) for w, g in sorted(seen, key=lambda x: (x[0].encode(), x[1]))]


def test_long_division_by_thousands():
    n = np.array([0, 1, 10**6, 10**12, 10**15 - 1], np.int64)
    whole = np.array([1, 3, 10**6 + 7, 10**12 + 11, 10**15 + 3], np.int64)
    assert divergence._shares(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), whole.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["op11_host_rules", "op12_merkle_manifest", "op13_source_divergence"])
def test_queries_against_sql(spark, data_dir, name, monkeypatch):
    monkeypatch.setattr(oracle, "TABLES", ["documents"])
    verdict, rows = compare(QUERIES[name](spark, data_dir), data_dir, ORACLES[name])
    assert verdict == "ok" and rows > 0
