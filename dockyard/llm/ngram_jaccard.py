"""Jaccard self-join of documents' word n-grams as a blocked sparse product of the document by n-gram incidence.

Only rows that can reach the threshold are multiplied. The steps:

1. Documents with equal n-gram sets collapse to one class, combined before the shuffle.
2. N-grams are ordered: rare ones by hash, those that a stated share of documents holds last, by count. A set
   that reaches similarity t with another shares one of its first n - ceil(t * n) + 1 n-grams with it (its head),
   whatever the order is; passages that many documents repeat so stay out of nearly all heads.
3. Columns of the head incidence are streamed, sorted by n-gram. A column's pairs are accumulated to overlap
   counts, and pairs whose sizes or counts exclude the threshold go. A column of more than COLUMN documents
   gives no pairs, so an entry never gives more than COLUMN / 2 of them; its documents are crowded ones.
4. For the crowded documents alone the n-grams are counted, and those that more than COLUMN of them hold are put last
   in a new order, by a bitmap of fixed size. Their heads by that order are streamed in the same way, and documents
   of one column beyond COLUMN are now chained to one community: they hold hardly an n-gram that isn't common, as near copies do,
   while a passage shared by documents that differ otherwise has left their heads. Any two crowded documents
   that are similar share a column of this order; others have shared a smaller column of the first one.
5. Communities (components of the surviving pairs and chains) are sorted by size and cut into blocks, by number
   of documents and by number of n-grams, so that a task's memory doesn't follow the documents' length. Two
   blocks whose size ranges can match are multiplied in one task from whole sets, which decides every pair
   exactly once. A task gives each document's number of links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockyard.llm.components import components, hub_join
from dockyard.llm.exact_dedup import one_each
from dockyard.llm.tables import fresh, keep, lowered
from dockyard.llm.words import blocks, shingle_sets

#: N-grams held by this share of documents are ordered last; at most (mean set size / share) of them exist.
HOT_SHARE = 0.0002
#: The most hot n-grams that are broadcast (16 bytes each); the share is raised until the bound holds.
HOT_MOST = 1 << 20
#: Columns with more documents give no pairs: their documents are crowded.
COLUMN = 64
#: Bits of the bitmap of n-grams that many crowded documents hold (16 MB). It may mark others; the order stays one for all.
COMMON_BITS = 27
#: Documents in a block of the product.
BLOCK = 2048
#: N-grams in a block of the product (8 bytes each, in several arrays); a set of more makes a block of its own.
BLOCK_GRAMS = 1 << 21
#: Digests a task holds to leave out repeated heads.
SEEN = 1 << 18
#: Places in the filter before the texts' shuffle: 2**26 bits.
MARK_BITS = 26

_HASH_BITS = np.uint64(57)


class Ratio:
    """The threshold as a whole fraction num/den, so that every comparison is exact."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def head(self, n):
        """How many n-grams of a set of n are its head."""
        return n - (n * self.num + self.den - 1) // self.den + 1

    def needed(self, a, b):
        """The least overlap with which sets of a and b n-grams are similar enough."""
        return ((a + b) * self.num + self.den + self.num - 1) // (self.den + self.num)


def ordered(codes: np.ndarray, hot: np.ndarray, counts: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """Keys that sort as the n-grams' global order and stay distinct: the magnitude of a hot one's count, then its hash.

    N-grams marked in the bitmap ``common`` stand behind all unmarked ones, before the hot ones.
    """
    keys = codes >> np.uint64(64 - int(_HASH_BITS))
    if common is not None:
        keys[_marks(common, codes)] |= np.uint64(1) << _HASH_BITS
    if len(hot) and len(codes):
        at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
        found = hot[at] == codes
        # A magnitude is 2 at least, so that hot n-grams follow the common ones.
        keys[found] &= (np.uint64(1) << _HASH_BITS) - np.uint64(1)
        keys[found] |= counts[at[found]] << _HASH_BITS
    return np.sort(keys)


def _marks(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & np.uint64((1 << COMMON_BITS) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def common_ngrams(docs: DataFrame, n: int, most: int):
    """A broadcast bitmap of the n-grams that more than ``most`` rows of ``docs`` hold, counted exactly.

    A task adds up what it meets before anything is shuffled, so copies in one task cost one entry.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def combined() -> pd.DataFrame:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"code": codes.view(np.int64), "n": counts.astype(np.int32)})

        for frame in frames:
            for _, found in _texts(frame, n):
                held.append(found)
                size += len(found)
                if size > 1 << 22:
                    yield combined()
                    held, size = [], 0
        if size:
            yield combined()

    counts = docs.mapInPandas(local, "code long, n int").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    at = F.col("code").bitwiseAND(F.lit((1 << COMMON_BITS) - 1))
    words = at.alias("at")
    words = counts.select(words).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (COMMON_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(out)


def _texts(frame: pd.DataFrame, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, raws in blocks(frame["text"].tolist()):
        for i, codes in enumerate(shingle_sets(raws, n), first):
            yield i, codes


def hot_ngrams(docs: DataFrame, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that about ``share`` of the documents hold, sorted, and the magnitude (log2) of their counts.

    What holds the share overall holds it in one task at least, so each task passes only its own candidates on.
    The counts are lower bounds; they order the heads and decide nothing.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, entries = [], 0, 0
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(codes, counts, held):
            every = np.concatenate([codes, *held])
            weights = np.concatenate([counts, np.ones(len(every) - len(codes), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weights = every[order], weights[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            return every[starts], np.add.reduceat(weights, starts) if len(starts) else weights

        size = 0
        for frame in frames:
            rows += len(frame)
            for _, found in _texts(frame, n):
                held.append(found)
                size += len(found)
                if size > 1 << 20:
                    codes, counts = merged(codes, counts, held)
                    entries, size, held = entries + size, 0, []
                    if len(codes) > 1 << 23:  # lossy counting: what is too rare here for the share by far goes
                        stay = counts > share * rows / 4
                        codes, counts = codes[stay], counts[stay]
        codes, counts = merged(codes, counts, held)
        stay = counts >= max(2, np.floor(share * rows))
        yield pd.DataFrame({"code": codes[stay].view(np.int64), "held": counts[stay]})
        yield pd.DataFrame({"code": [None], "held": [rows]}, dtype=object).astype({"code": "Int64", "held": "int64"})

    found = keep(docs.mapInPandas(local, "code long, held long").groupBy("code").agg(F.sum("held").alias("held")), "hot")
    rows = found.where("code is null").agg(F.sum("held")).first()[0] or 0
    least = max(2.0, share * rows)
    while True:
        hot = found.where(F.col("code").isNotNull() & (F.col("held") >= least))
        if hot.count() <= HOT_MOST:
            break
        least *= 2
    hot = hot.toPandas()
    codes = hot["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    marks = np.minimum(np.log2(np.maximum(hot["held"].to_numpy(float), 2)).astype(np.uint64) + np.uint64(1), np.uint64(127))
    return codes[order], marks[order]


def _digest(codes: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def heads(docs: DataFrame, n: int, ratio: Ratio, hot, common=None) -> DataFrame:
    """Per row: id, key (of its text), n_shingles, digest (of its set), code (the digest's first 64 bits) and head.

    A task gives the head of equal sets once, or again after SEEN other sets; their later rows have a null head.
    ``common`` is the bitmap of the second order.
    """

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_codes, counts = hot.value
        seen: set[bytes] = set()
        for frame in frames:
            sizes, digests, codes, found = [], [], [], []
            for _, grams in _texts(frame, n):
                size = len(grams)
                digest = _digest(grams) if size else None
                sizes.append(size)
                digests.append(digest)
                codes.append(int.from_bytes(digest[:8], "little", signed=True) if size else 0)
                new = size > 0 and digest not in seen
                found.append(ordered(grams, hot_codes, counts, common and common.value)[: ratio.head(size)].view(np.int64) if new else None)
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"], "n_shingles": sizes, "digest": digests, "code": codes, "head": found})

    return docs.mapInPandas(made, "id long, key long, n_shingles long, digest binary, code long, head array<long>")


def _pairs(members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ratio: Ratio) -> Iterator[pd.DataFrame]:
    """The pairs of each column of 2 to COLUMN members whose sizes can match; columns of equal length together."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= COLUMN)]).tolist():
        i, j = np.triu_indices(size, 1)
        first = starts[sizes == size]
        for lo in range(0, len(first), step := max(1, (1 << 18) // len(i))):
            at = first[lo : lo + step, None]
            x, y = members[(at + i).ravel()], members[(at + j).ravel()]
            small, large = np.minimum(x[:, 1], y[:, 1]), np.maximum(x[:, 1], y[:, 1])
            fit = small * ratio.den >= large * ratio.num
            x, y = x[fit], y[fit]
            swap = x[:, :1] > y[:, :1]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pd.DataFrame({"a": x[:, 0], "b": y[:, 0], "na": x[:, 1], "nb": y[:, 1]})


def _columns(ratio: Ratio):
    """Streams sorted columns: pairs (a, b, na, nb) of small ones, chains (a, b, -1, -1) of large ones."""

    def chained(members: np.ndarray, first: int) -> pd.DataFrame:
        return pd.DataFrame({"a": np.full(len(members), first), "b": members[:, 0], "na": -1, "nb": -1})

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The last column may go on in the next batch: its members are held, or its first one once it is chained.
        grams, members = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        last, leader = None, None
        for frame in frames:
            new, rows = frame["gram"].to_numpy(np.int64), frame[["cls", "n"]].to_numpy(np.int64)
            if leader is not None:
                more = int(np.searchsorted(new, last, "right"))
                if more:
                    yield chained(rows[:more], leader)
                new, rows = new[more:], rows[more:]
                if not len(new):
                    continue
                leader = None
            grams, members = np.concatenate((grams, new)), np.concatenate((members, rows))
            # Tasks that met equal sets sent the same entry; sorted, repeats are neighbours.
            once = np.ones(len(grams), bool)
            once[1:] = (grams[1:] != grams[:-1]) | (members[1:, 0] != members[:-1, 0])
            grams, members = grams[once], members[once]
            starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(grams)))
            yield from _pairs(members, starts[:-1], sizes[:-1], ratio)
            for k in np.flatnonzero(sizes > COLUMN).tolist():
                part = members[starts[k] : starts[k] + sizes[k]]
                yield chained(part, int(part[0, 0]))
            if sizes[-1] > COLUMN:
                last, leader = int(grams[-1]), int(members[starts[-1], 0])
                grams, members = grams[:0], members[:0]
            else:
                grams, members = grams[starts[-1] :], members[starts[-1] :]
        if len(grams):
            yield from _pairs(members, np.zeros(1, np.int64), np.array([len(grams)]), ratio)

    return streamed


def _product(ratio: Ratio, n: int):
    """Multiplies the blocks of one unit; gives links per class and a spanning forest."""

    def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """How many n-grams each left set shares with each right set."""
        codes = np.concatenate([*left, *right])
        if not len(codes):
            return np.zeros((len(left), len(right)), np.float32)
        owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        starts = np.concatenate(([True], codes[1:] != codes[:-1]))
        column = np.cumsum(starts) - 1
        many = np.bincount(column) > 1
        rank = np.cumsum(many) - 1
        stay = many[column]
        column, owner = rank[column[stay]], owner[stay]
        total = np.zeros((len(left), len(right)), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, [lo, lo + width])
            dense = np.zeros((len(left) + len(right), width), np.float32)
            dense[owner[s:e], column[s:e] - lo] = 1
            total += dense[: len(left)] @ dense[len(left) :].T
        return total

    def unit(frame: pd.DataFrame) -> pd.DataFrame:
        links, edges = [], []
        for (_, i, j), group in frame.groupby(["community", "i", "j"], sort=False):
            group = group.drop_duplicates("cls")
            sets = {}
            rows = group[["cls", "block", "weight"]].to_numpy(np.int64)
            for first, raws in blocks(group["text"].tolist()):
                sets.update(enumerate(shingle_sets(raws, n), first))
            left = [k for k in range(len(rows)) if rows[k, 1] == i]
            right = left if i == j else [k for k in range(len(rows)) if rows[k, 1] == j]
            if not left or not right:
                continue
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            sizes = np.array([len(sets[k]) for k in range(len(rows))], np.int64)
            near = both.astype(np.int64) >= ratio.needed(sizes[left][:, None], sizes[right][None, :])
            if i == j:
                np.fill_diagonal(near, False)
            weight = rows[:, 2]
            for here, there, table in ((left, right, near), *(() if i == j else ((right, left, near.T),))):
                counts = table @ weight[there]
                links += [(int(rows[k, 0]), None, int(c)) for k, c in zip(here, counts, strict=True) if c]
            root = list(range(len(rows)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in np.argwhere(near).tolist():
                a, b = find(left[x]), find(right[y])
                if a != b:
                    root[a] = b
                    edges.append((int(rows[left[x], 0]), int(rows[right[y], 0]), 0))
        return pd.DataFrame(links + edges, columns=["a", "b", "links"]).astype({"a": "Int64", "b": "Int64", "links": "int64"})

    return unit


def _marked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` but for most of those whose keys don't occur in ``wanted``.

    The filter is a bitmap of 2**MARK_BITS hash places, at most 8 MB whatever the input is. It lets all wanted rows through and
    some others; the fuller it is, the more others, down to no effect. It only saves shuffling.
    """

    def places(df: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64(*keys), F.lit(1 << MARK_BITS))
        return df.select("*", F.shiftright(place, 15).alias("shelf"), F.pmod(place, F.lit(1 << 15)).alias("place"))

    bits = places(wanted.select(*keys)).groupBy("shelf").agg(F.bitmap_construct_agg("place").alias("bits"))
    bit = F.expr("getbit(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) = 1")
    return places(rows).join(F.broadcast(bits), "shelf").where(bit).select(*rows.columns)


def blocked(members: DataFrame, block: int, grams: int) -> DataFrame:
    """``members`` (community, cls, n_shingles, ...) with the block of each: some ``block`` classes and ``grams`` n-grams at most.

    The window runs over the distinct sizes of a community; classes of one size are dealt over its places by hash.
    """
    sizes = members.groupBy("community", "n_shingles").agg(F.count("*").alias("many"))
    upto = Window.partitionBy("community").orderBy("n_shingles")
    sizes = sizes.withColumns({"upto": F.sum("many").over(upto), "grams": F.sum(F.col("many") * F.col("n_shingles")).over(upto)})
    ranked = members.join(sizes, ["community", "n_shingles"]).withColumn("behind", F.expr("1 + pmod(xxhash64(cls), many)"))
    # Neither number falls from place to place, so their sum is the same only where both are.
    number = F.expr(f"(upto - behind) div {block} + (grams - behind * n_shingles) div {grams}")
    return ranked.withColumn("block", number).drop("many", "upto", "grams", "behind")


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, share: float = HOT_SHARE, grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id, n_links, and the row's number and the one of its component's first row.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z lower-cased. A set holds the
    distinct n-word shingles, or the whole sequence where words are fewer. Sets a and b are linked when
    den * |a & b| >= num * |a | b|. component_id is the smallest doc_id that links reach; n_links counts the other
    rows linked directly, equal sets included; class_id numbers the equal sets. Null, empty and blank texts
    have n_shingles 0, link with nothing and are their own component. A null doc_id is skipped by the
    minimum. Rows repeated whole are linked like other copies, and a pair exactly at the threshold is linked. Very long texts are sets like
    others and make blocks of their own. An empty table gives no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    ratio = Ratio(num, den)
    # A generator's output is computed once per row; a plain column would be lower-cased anew for each use of it.
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.explode(F.array(lowered(F.col("text")))).alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    hot = spark.sparkContext.broadcast(hot_ngrams(source.select("text"), n, share))
    rows = keep(heads(source, n, ratio, hot).withColumn("row", F.monotonically_increasing_id()), "heads")

    # Classes of equal sets; the row with the smallest id stands for the class and numbers it.
    classes = (
        rows.where("digest is not null").groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "key", "n_shingles", "code")).alias("m"), F.count("*").alias("weight"))
        .select("digest", "weight", F.col("m.row").alias("cls"), F.col("m.id").alias("least"), "m.key", "m.n_shingles", "m.code")
    )
    classes = keep(classes, "classes")
    # Columns name a set by its code, which every copy knows, so heads needn't meet their classes. Sets whose codes
    # are equal by chance come into one community; whole sets decide there.
    def streamed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The columns of these heads, and the pairs of small ones that counts and sizes don't exclude."""
        entries = rows.where("head is not null").select(F.explode("head").alias("gram"), F.col("code").alias("cls"), F.col("n_shingles").cast("int").alias("n"))
        found = entries.repartition("gram").sortWithinPartitions("gram", "cls").mapInPandas(_columns(ratio), "a long, b long, na int, nb int")
        found = keep(found, name)
        head = (f"greatest({x} - ({x} * {num} + {den} - 1) div {den} + 1, 0)" for x in ("na", "nb"))
        shared = found.where("na >= 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        # What a pair shares lies in both heads or behind the end of one of them.
        reach = F.expr(f"shared + greatest(na - {next(head)}, nb - {next(head)}) >= ((na + nb) * {num} + {den + num - 1}) div {den + num}")
        return found, shared.where(reach).select("a", "b")

    found, pairs = streamed(rows, "columns")
    crowded = found.where("na < 0").select(F.explode(F.array("a", "b")).alias("code")).distinct()
    crowded = keep(classes.join(crowded, "code", "left_semi").select(F.col("least").alias("id"), "key"), "crowded")
    if not crowded.isEmpty():
        # One row of each crowded set, and a few others that the filter lets through: they only make the superset larger.
        some = _marked(source, crowded, "key", "id")
        common = common_ngrams(some.select("text"), n, COLUMN)
        again = keep(heads(some, n, ratio, hot, common), "crowded-heads")
        found, more = streamed(again, "crowded-columns")
        pairs = pairs.unionByName(more)
    chains = found.where("na < 0 and a <> b").select("a", "b").distinct()
    member = components(pairs.unionByName(chains)).select(F.col("node").alias("code"), F.col("root").alias("community"))

    # Blocks: a community's classes by size. Communities of one block share units by hash.
    info = classes.select("code", "cls", F.col("least").alias("id"), "key", "n_shingles", "weight")
    members = keep(member.join(info, "code").drop("code"), "members")
    ranked = keep(blocked(members, block, grams), "ranked")
    size = ranked.groupBy("community", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    last = size.groupBy("community").agg(F.max("block").alias("last"))
    classes_in, grams_in = ranked.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    units = max(1, -(-classes_in // block), -(-grams_in // grams)) * 4
    left, right = size.alias("l"), size.alias("r")
    matched = left.join(right, F.expr(f"l.community = r.community and l.block <= r.block and l.hi * {den} >= r.lo * {num}"))
    matched = matched.select("l.community", F.col("l.block").alias("i"), F.col("r.block").alias("j")).join(last, "community")
    matched = matched.select("community", "i", "j", F.when(F.col("last") == 0, F.pmod(F.xxhash64("community"), F.lit(units))).otherwise(units + F.pmod(F.xxhash64("community", "i", "j"), F.lit(1 << 40))).alias("unit"))
    placed = matched.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    wanted = ranked.join(placed, ["community", "block"])
    # Texts meet their units in one join; rows outside communities stay out of its shuffle.
    likely = _marked(source, wanted, "key", "id").alias("s")
    work = likely.join(wanted.alias("w"), F.expr("s.key = w.key and s.id <=> w.id")).select("cls", "text", "community", "block", "i", "j", "unit", "weight")
    # A task's work is its number of block pairs, not its bytes, so the number of tasks isn't left to their size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-matched.count() // 64))
    product = keep(work.repartition(tasks, "unit").groupBy("unit").applyInPandas(_product(ratio, n), "a long, b long, links long"), "links")

    roots = components(product.where("b is not null").select("a", "b"))
    degree = product.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    linked = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    linked = keep(linked.join(degree, "cls", "left"), "linked")
    # A class's number is its first row by (no id, id, row); so is the number of the component's first class.
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("m"), F.count("*").alias("n"))
    least = least.select("root", F.col("m.least").alias("component_id"), F.col("m.cls").alias("first_row"), "n")
    answer = hub_join(linked, least, "root", linked.count()).select("digest", F.col("cls").alias("class_id"), "component_id", "first_row", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # Rows without shingles have no digest; they keep out of the join, where they would be one key.
    some = rows.where("digest is not null").join(answer, "digest").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links", "row", "first_row", "key")
    none = rows.where("digest is null").select(F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id"), F.col("row").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "row", F.col("row").alias("first_row"), "key")
    return some.unionByName(none)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the smallest doc_id; others go.

    A null id is larger than any. Of linked rows with one id, or none with an id, the first stays. Rows without shingles
    stay; of those that repeat id and text one stays.
    """
    key, seen, text_key, number = (fresh(docs, x) for x in ("near_key", "near_id", "near_text", "near_number"))
    found = join(docs)
    kept = found.where("row = first_row")
    kept = kept.select(F.col("key").alias(key), F.col("doc_id").alias(seen)).distinct()
    rows = docs.withColumn(text_key, F.xxhash64(lowered(docs["text"])))
    rows = rows.join(kept, (rows[text_key] == kept[key]) & docs["doc_id"].cast("long").eqNullSafe(kept[seen]), "left_semi")
    return one_each(rows, [text_key, "doc_id"], number).drop(text_key)
