"""How far the sources of a language differ in the words they use.

Counting is a sort of pointers: a task marks where words begin in its Arrow text buffers, and a multikey quicksort orders
these pointers by the words behind them, eight bytes at a time, slices of equal prefixes on their own. In each run of
equal words the neighbouring pointers give the documents and the sources that hold the word. One row per word, source
and shard leaves the task; all arithmetic behind it is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockyard.llm.tables import keep

#: Bytes of text whose pointers are sorted together; a longer text is a shard of its own. Sorting takes some 15 bytes for each
#: of them, in every task at once; what shards have in common is added up behind them, before the shuffle.
SHARD_BYTES = 1 << 22
#: A word is kept in a language where as many of its documents hold it.
LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Sources of a language that are compared in one task, entries (word, source) it gets, and words it spreads out at a time.
SOURCES = 256
ENTRIES = 1 << 18
SPREAD = 2048

#: What a byte is in a word: A-Z lower-cased, a-z and bytes of characters beyond U+007F as they are, 0 for all others.
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)

#: Keeps the first 0 to 8 bytes of a big-endian key.
_FIRST = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9)], np.uint64)


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each word from byte 8 * depth on, zeros behind its end. ``data`` ends in eight spare bytes."""
    view = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    left = np.clip(sizes - 8 * depth, 0, 8)
    at = np.where(left > 0, starts + 8 * depth, 0)
    return view[at].astype(np.uint64) & _FIRST[left]


def sorted_pointers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pointers by their words, and marks of where runs of equal words begin.

    Multikey quicksort: a slice is sorted by its next eight bytes, and only slices of equal bytes whose words go on are
    sorted further. Slices of one depth are sorted in one call. Equal words keep the order of their pointers.
    """
    key = _keys(data, starts, sizes, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(order), bool)
    first[1:] = key[1:] != key[:-1]
    depth = 1
    active = np.arange(len(order))
    while True:
        # Slices of two pointers or more that hold a word that goes on.
        slices = np.cumsum(first[active]) - 1
        longer = sizes[order[active]] > 8 * depth
        count = int(slices[-1]) + 1 if len(slices) else 0
        wanted = (np.bincount(slices, longer, count) > 0) & (np.bincount(slices, minlength=count) > 1)
        chosen = wanted[slices]
        active, slices = active[chosen], slices[chosen]
        if not len(active):
            return order, first
        held = order[active]
        key = _keys(data, starts[held], sizes[held], depth)
        again = np.lexsort((key, slices))
        order[active] = held[again]
        key = key[again]
        differs = (key[1:] != key[:-1]) | (slices[1:] != slices[:-1])
        first[active[1:]] |= differs
        depth += 1


def shard_counts(texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that end in a line break each: words, groups, occurrences and documents, one entry per word and group.

    ``groups`` has each text's group and doesn't fall.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = _LETTER[raw]
    inside = data != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    order, first = sorted_pointers(data, starts, sizes)
    starts, sizes = starts[order], sizes[order]
    docs = np.searchsorted(offsets, starts, "right") - 1
    new_doc, new_group = first.copy(), first.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    group = groups[docs]
    new_group[1:] |= group[1:] != group[:-1]
    at = np.flatnonzero(new_group)
    counts = np.diff(np.append(at, len(order)))
    held_by = np.add.reduceat(new_doc.astype(np.int64), at)
    # The words' bytes one after the other.
    runs = np.flatnonzero(first)
    ends = np.cumsum(sizes[runs])
    begins = ends - sizes[runs]
    flat = data[np.repeat(starts[runs] - begins, sizes[runs]) + np.arange(ends[-1])]
    words = pa.LargeStringArray.from_buffers(len(runs), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat))
    return words.take(pa.array(np.searchsorted(runs, at, "right") - 1)), group[at], counts, held_by


_SCHEMA = "lang string, source string, term string, n long, docs long"


def word_counts(docs: DataFrame) -> DataFrame:
    """Per lang, source and word: occurrences ``n`` and documents ``docs``. Shards are combined before the shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            pairs = pd.MultiIndex.from_arrays([table.column("lang").to_pandas(), table.column("source").to_pandas()])
            groups, names = pairs.factorize()
            order = np.argsort(groups, kind="stable")
            texts = table.column("text").cast(pa.large_string()).take(pa.array(order)).combine_chunks()
            texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
            words, group, n, docs = shard_counts(texts, groups[order])
            langs, sources = (pa.array(names.get_level_values(i).tolist(), pa.string()) for i in (0, 1))
            for a in range(0, len(words), 1 << 16):
                part = slice(a, a + (1 << 16))
                which = pa.array(group[part])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(which), sources.take(which), words[part].cast(pa.string()), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"]
                )

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    texts = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = docs.select(_text("lang"), _text("source"), texts.alias("text"))
    return rows.mapInArrow(made, _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) on whole numbers of any size."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({n} + 1 AS decimal(20,0))) div cast({total} + {terms} AS decimal(20,0))")


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays: a long division by thousands, so that nothing leaves 64 bits."""
    rest = n + 1
    found = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


def pair_sums(entries: pd.DataFrame, stats: pd.DataFrame, x: int, y: int) -> pd.DataFrame:
    """Over the words of ``entries`` (at, term, n): for each ordered pair of sources of blocks x and y the sum of f.

    ``stats`` has all sources of both blocks (idx, source, total, terms). Also given are the number of words and the f of
    a word that neither source holds.
    """
    stats = stats.sort_values("idx")
    idx = stats["idx"].to_numpy()
    names = stats["source"].tolist()
    whole = stats["total"].to_numpy() + stats["terms"].to_numpy()
    zero = _shares(np.zeros(len(idx), np.int64), np.maximum(whole, 1))
    column = np.searchsorted(idx, entries["at"].to_numpy())
    code, distinct = pd.factorize(entries["term"], sort=False)
    value = _shares(entries["n"].to_numpy(), whole[column]) if len(entries) else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, column, value = code[order], column[order], value[order]
    sums = np.zeros((len(idx), len(idx)), np.int64)
    for low in range(0, len(distinct), SPREAD):
        high = min(low + SPREAD, len(distinct))
        a, b = np.searchsorted(code, [low, high])
        p = np.repeat(zero[None, :], high - low, axis=0)
        p[code[a:b] - low, column[a:b]] = value[a:b]
        for i in range(len(idx)):
            gap = p[:, i : i + 1] - p
            sums[i] += (gap * gap // p).sum(axis=0)
    of = idx // SOURCES
    first, second = np.nonzero((idx[:, None] != idx[None, :]) & ((of[:, None] == x) & (of[None, :] == y) | (of[:, None] == y) & (of[None, :] == x)))
    gap = zero[first] - zero[second]
    return pd.DataFrame({
        "source": [names[i] for i in first], "item": [names[i] for i in second],
        "part_sum": sums[first, second], "n_terms": len(distinct), "absent": gap * gap // zero[second],
    })


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources differ from each other, and by which words from their language.

    Words are runs of ASCII letters, lower-cased, and of characters beyond U+007F. Each lang keeps those that ``least`` of its
    documents hold. Null text, lang and source count as empty ones; empty texts hold no words, but their (lang, source)
    counts as one that occurs; very long texts are counted whole. Rows repeated whole are documents of their own. Ties
    in value stand in the order of their items. An empty table gives no rows, and columns other than text, lang and source aren't read.
    """
    groups = keep(docs.select(_text("lang"), _text("source")).distinct(), "groups")
    counts = keep(word_counts(docs), "words")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least).select("lang", "term", "n_lang")
    terms = keep(terms, "terms")
    entries = keep(counts.drop("docs").join(terms, ["lang", "term"]), "entries")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    stats = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    # One row per source of a language, of which the result has as many as pairs.
    idx = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    stats = keep(stats.select("lang", "source", idx.alias("idx"), *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "total_lang")]), "sources")
    pairs = source_pairs(entries, stats)
    return pairs.unionByName(telling_words(entries, stats, top))


def telling_words(entries: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    """The words by which a source stands out from its language, at most ``top`` of each."""
    # The sources' table is broadcast where its stored size allows; else a large source is split by the adaptive join.
    rows = entries.join(stats.drop("idx"), ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("n_lang", "total_lang", "terms")})
    rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # The limit on the rank is pushed below the shuffle, so a source sends ``top`` rows a task.
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def source_pairs(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """Each ordered pair of sources of a language with the sum of f over all its words.

    Words are dealt over tasks of some ENTRIES entries, sources over blocks of SOURCES; a task adds up all its words for
    all its pairs, and one row per pair and task is shuffled.
    """
    shape = stats.agg(F.max("idx").alias("most")).first()["most"] or 0
    blocks = shape // SOURCES + 1
    shards = entries.count() * blocks // ENTRIES + 1
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    def sides(df: DataFrame, number: str, *columns: str | Column) -> DataFrame:
        block = F.expr(f"{number} div {SOURCES}")
        dealt = df.select("*", other).withColumns({"x": F.least(block, "other").cast("long"), "y": F.greatest(block, "other").cast("long")})
        return dealt.select("lang", "x", "y", *columns)

    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard")
    numbered = entries.join(stats.select("lang", "source", F.col("idx").alias("at")), ["lang", "source"])
    words = sides(numbered, "at", shard, "at", "term", "n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    sources = sides(stats.select("lang", "idx", "source", "total", "terms"), "idx", every, "idx", "source", "total", "terms")

    schema = "lang string, source string, item string, part_sum long, n_terms long, absent long"
    names = [x.split()[0] for x in schema.split(", ")]

    def added(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pair_sums(left, right, key[1], key[2])
        # Plain objects: Arrow takes them also where a block holds one source and so no pair.
        return found.assign(lang=key[0])[names].astype({"lang": object, "source": object, "item": object})

    keys = ["lang", "x", "y", "shard"]
    parts = words.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInPandas(added, schema)
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("s"), F.sum("n_terms").alias("n"), F.max("absent").alias("absent"))
    terms = stats.groupBy("lang").agg(F.max("terms").alias("terms"))
    value = sums.join(terms, "lang").select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("s + (terms - n) * absent").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", rank)
