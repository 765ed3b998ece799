"""Quality rules decided by host, in DataFrame functions only.

Each document is held against a few rules; failures are added up per host (the domain of ``source``). A host's failure
rates are shrunk towards a beta prior fitted to all hosts' rates, so a host of two documents is not judged like one
of two million, and the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockyard.llm.tables import fresh, keep, lowered

BLANKS = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: The scheme, user and ``www.`` before a host, and what follows it, are no part of it.
HOST = r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)"

#: A host whose shrunk failure rate of any rule is above this loses its documents.
LIMIT = 0.5
#: The least and the largest weight of a prior, in documents: hosts that are either clean or junk fit one of no weight, and
#: one document of one would be a verdict; hosts that don't differ fit one of endless weight.
WEAKEST, STRONGEST = 10.0, 1_000_000.0
#: Rates are counted in units of this part, so their sums over hosts are exact in any order.
UNITS = 1_000_000
#: Parts into which the documents of one host are dealt where verdicts are too many to broadcast.
SALTS = 32

#: Rules as SQL over the counts of one document; a document fails where one is true.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_size": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repeats")


#: The low bits of a window's code hold its place; no text has more words.
PLACE_BITS = 28


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the new columns, each computed once however often later steps name it: a generator isn't merged with them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


def _window_codes(words: Column, width: int) -> Column:
    """Per window a hash with the window's place in its low bits."""
    places = F.sequence(F.lit(0), F.size(words) - width)

    def code(i: Column) -> Column:
        h = F.xxhash64(*[F.get(words, i + k) for k in range(width)])
        return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    empty = F.array().cast("array<bigint>")
    return F.when(F.size(words) <= width, empty).otherwise(F.transform(places, code))


def _neighbours(entries: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
    """The places, ascending, of sorted entries that are the same as the entry before or behind them."""
    later = F.filter(F.sequence(F.lit(1), F.size(entries) - 1), lambda i: same(F.get(entries, i), F.get(entries, i - 1)))
    both = F.transform(later, lambda i: F.array(place(F.get(entries, i - 1)), place(F.get(entries, i))))
    return F.when(F.size(entries) < 2, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(F.flatten(both))))


def _covered(places: Column, width: int) -> Column:
    """How many words the windows at these places cover."""
    start = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(done: Column, at: Column) -> Column:
        return F.struct(at.alias("last"), (done["n"] + F.least(F.lit(width).cast("long"), at - done["last"])).alias("n"))

    return F.aggregate(places, start, step, lambda x: x["n"])


def repeated_words(df: DataFrame, keep: list[str], words: str, name: str, width: int = WINDOW) -> DataFrame:
    """``keep`` and ``name``: the words in windows of ``width`` words that occur twice or more, first occurrences included.

    Codes of windows are sorted within the row; where hashes meet, the windows themselves are compared, so the count is
    exact. ``words`` is a column of its own, which no later step computes anew.
    """
    mask = (1 << PLACE_BITS) - 1

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.slice(words, (i + 1).cast("int"), F.lit(width))).alias("c"), i.alias("i"))

    coded = computed(df, [*keep, words], _codes=F.sort_array(_window_codes(F.col(words), width)))
    hits = _neighbours(F.col("_codes"), lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), lambda x: x.bitwiseAND(F.lit(mask)))
    found = computed(coded, [*keep, words], _hits=hits)
    checked = computed(found, keep, _windows=F.sort_array(F.transform("_hits", window)))
    places = computed(checked, keep, _places=_neighbours(F.col("_windows"), lambda a, b: a["c"] == b["c"], lambda x: x["i"]))
    return places.select(*keep, _covered(F.col("_places"), width).alias(name))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_of(source: Column) -> Column:
    """The domain of an address, A-Z lower-cased; a plain name is its own domain. Null where there is none."""
    return F.nullif(F.regexp_extract(lowered(source), HOST, 1), F.lit(""))


def document_counts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, host, the counts and a flag ``bad_<rule>`` per rule. The texts are read here alone and not shuffled."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(VISIBLE))
    split = computed(docs.select("doc_id", "source", "text"), ["doc_id", "source"], _words=words_of(text), _lines=lines, n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    counts = split.select(
        "doc_id", host_of(F.col("source").cast("string")).alias("host"), "_words", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = [c for c in counts.columns if c != "_words"]
    counted = repeated_words(counts, kept, "_words", "n_repeat_words")
    return counted.select("*", *[F.expr(rule).alias(f"bad_{name}") for name, rule in RULES.items()])


def host_rates(counted: DataFrame) -> DataFrame:
    """Per host: n documents, and per rule its failures ``k_<rule>``; combined before the shuffle."""
    return counted.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(f"bad_{r}").alias(f"k_{r}") for r in RULES])


def prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Per rule the mean and the weight (in documents) of a beta prior with the moments of the hosts' rates.

    One row of sums reaches the driver. Sums are over whole units, so they are the same however the hosts are dealt.
    """
    part = {r: F.expr(f"({UNITS} * k_{r}) div n").cast("decimal(20,0)") for r in RULES}
    sums = hosts.agg(F.count("*").alias("h"), *[F.sum(p).alias(f"s_{r}") for r, p in part.items()], *[F.sum(p * p).alias(f"t_{r}") for r, p in part.items()]).first()
    found = {}
    for r in RULES:
        h = sums["h"]
        if not h:
            found[r] = 0.0, STRONGEST
            continue
        mean = float(sums[f"s_{r}"]) / float(h * UNITS)
        spread = float(sums[f"t_{r}"]) / float(h * UNITS) / UNITS - mean * mean
        weight = mean * (1.0 - mean) / spread - 1.0 if spread > 0 else STRONGEST
        found[r] = mean, min(max(weight, WEAKEST), STRONGEST)
    return found


def host_verdicts(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``hosts`` with a shrunk failure rate ``rate_<rule>`` per rule, and ``host_failed``: one of them is above ``limit``."""
    rates = {f"rate_{r}": (F.col(f"k_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)) for r, (mean, weight) in prior(hosts).items()}
    return hosts.withColumns(rates).withColumn("host_failed", F.greatest(*[F.col(name) > limit for name in rates]))


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept, host and host_failed.

    ``kept`` is false for documents that fail a base rule, else false where their host failed. Null texts count as
    empty and fail (no words); documents without a host (null or blank source) are judged by the base rules alone. Words,
    lines and windows are those of the whole text, however long; each of rows repeated whole is judged, and counts in its
    host. A rate that ties with the limit passes. An empty table gives no rows; columns other than doc_id, text and
    source aren't read, whatever their names are.
    """
    counted = keep(document_counts(docs), "host-counts")
    hosts = keep(host_rates(counted), "hosts")
    failed = keep(host_verdicts(hosts, limit).where("host_failed").select(F.col("host").alias("bad_host")), "bad-hosts")
    # A host may hold a third of all rows: its documents are dealt over salts, its one verdict is repeated for each.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    sides = failed.select("bad_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    joined = counted.withColumn("salt", salt).join(sides, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    base = F.greatest(*[F.col(f"bad_{r}") for r in BASE])
    bad_host = F.col("bad_host").isNotNull()
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & ~bad_host).alias("kept"), "host", bad_host.alias("host_failed"))


def accepted(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; a null or repeated doc_id goes by its own row's verdict."""
    row = fresh(docs, "row")
    stored = keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    verdicts = judge(stored.select(F.col(row).alias("doc_id"), "text", "source"), limit).where("kept").select(F.col("doc_id").alias(row))
    return stored.join(verdicts, row, "left_semi").select(*docs.columns)
