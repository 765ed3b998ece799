"""Secret scans behind a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: an OR of ANDs of three-character strings that
every match must hold, lower-cased. One pass writes the postings of these trigrams (trigram, document); the
postings of each AND are intersected by document, and only documents that satisfy a rule's query are matched
against its regex. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockyard.llm.tables import fresh, keep, lowered

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that Java and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: What may stand between a key's BEGIN and END lines: base64, header fields, line breaks (escaped ones too), marks of quotes and comments.
_KEY_BODY = r"""[A-Za-z0-9+/=\x20\t\r\n:,\\"'>#*|-]*"""
#: Where no END line follows, only what can't be prose is the key's: header fields and runs of base64 behind line breaks or blanks
#: (escaped ones too, whose n the run takes in), and behind such a run a short one that no word looks like. A key has 147 lines at most; engines that
#: both must read the pattern allow no larger bounds on nested repeats than these.
_KEY_BREAK = r"""[\x20\t\r\n"'>#*|\\]*(?:r\\+)?"""
_KEY_LINE = rf"""(?:{_KEY_BREAK}(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*|[A-Za-z0-9+/=]{{20,}}),?)"""
_KEY_LINES = rf"""{_KEY_LINE}{{1,49}}{_KEY_LINE}{{0,49}}{_KEY_LINE}{{0,49}}(?:{_KEY_BREAK}[A-Za-z]*[0-9+/=][A-Za-z0-9+/=]*)?(?:[\r\n]+$)?"""

#: In the order in which spans with the same start are listed.
#: A maximal run of 16 or more is the same match as a run of any length that is dropped below 16 (hex, access);
#: for assign the length is tested afterwards, since a short value still uses up its text.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # The whole block; one without an END line reaches as far as its lines do.
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_KEY_BODY}?-----END [A-Z ]{{0,30}}PRIVATE KEY-----|{_KEY_LINES})?"),
)

_MOST = 64  # alternatives that a derivation keeps apart
TRUE = frozenset({frozenset()})


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorbed(query: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    return frozenset(x for x in query if not any(y < x for y in query))


def _exact(op, value) -> set[str] | None:
    """All strings that a node matches, where these are few."""
    if op is sre.LITERAL:
        return {chr(value)}
    if op is sre.IN and all(x is sre.LITERAL for x, _ in value) and len(value) <= 6:
        return {chr(c) for _, c in value}
    if op is sre.BRANCH:
        parts = [_exact_all(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.SUBPATTERN:
        return _exact_all(value[3])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1:
        inner = _exact_all(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _exact_all(nodes) -> set[str] | None:
    found = {""}
    for op, value in nodes:
        part = _exact(op, value)
        if part is None or len(found) * len(part) > _MOST:
            return None
        found = {a + b for a in found for b in part}
    return found


def _query(nodes) -> frozenset[frozenset[str]]:
    states = {("", frozenset())}  # the literal text just read, and the trigrams required before it

    def cut(states):
        return {("", need | _trigrams(tail)) for tail, need in states}

    for op, value in nodes:
        part = _exact(op, value)
        if part is not None and len(part) * len(states) <= _MOST:
            states = {(tail + x, need) for tail, need in states for x in part}
            continue
        states = cut(states)
        inner = TRUE
        if op is sre.SUBPATTERN:
            inner = _query(value[3])
        elif op is sre.BRANCH:
            inner = frozenset().union(*(_query(x) for x in value[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            inner = _query(value[2])
        inner = _absorbed(inner)
        if len(inner) * len(states) <= _MOST:
            states = {("", need | x) for _, need in states for x in inner}
    return _absorbed(frozenset(need for _, need in cut(states)))


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that each match holds; an empty AND means that every text is a candidate."""
    return _query(sre_parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of (id, key, text) for the given trigrams: (trigram, id, key)."""
    text = lowered(F.col("text"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.col("_lower"), g))
    return docs.withColumn("_lower", text).select(F.explode(held).alias("trigram"), "id", "key")


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(id, key, kinds): the documents whose postings satisfy the rules' queries. The queries are parameters, not data."""
    terms = []
    for kind, query in queries.items():
        for number, need in enumerate(sorted(query, key=sorted)):
            terms += [(kind, number, g, 1 << i, (1 << len(need)) - 1) for i, g in enumerate(sorted(need))]
    wanted = index.sparkSession.createDataFrame(terms, "kind string, number int, trigram string, bit long, whole long")
    found = index.join(F.broadcast(wanted), "trigram").groupBy("id", "key", "kind", "number").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"))
    return found.where("bits = whole").groupBy("id", "key").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's spans in a text, in code points: matches and the gaps between them give the places."""
    pattern = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    sizes = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(found.alias("m"), F.transform(sizes, F.char_length).alias("n"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    empty = F.array().cast(SPANS)
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.char_length(x["g"])
        end = begin + F.char_length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.cast("long").alias("at"), F.when(x["n"] >= rule.least, F.concat(done["spans"], F.array(span).cast(SPANS))).otherwise(done["spans"]).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda x: x["spans"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a column of spans, ordered by start, then by the rules' order; its name is returned by ``spans_name``.

    Per rule, matches are leftmost and don't overlap; those whose group is shorter than the rule's least length
    are dropped. Null texts count as empty and have no spans; texts are matched whole, however long. Spans that begin together stand in the
    rules' order. Rows repeated whole get the same spans, and an empty table gives none. The
    columns added have names that ``docs`` doesn't use.
    """
    name = spans_name(docs)
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    trigrams = sorted({g for q in indexed.values() for need in q for g in need})
    if trigrams:
        index = keep(postings(slim, trigrams), "postings")
        hits = candidates(index, indexed)
    else:
        hits = spark.createDataFrame([], "id string, key long, kinds array<string>")
    key, kinds, number = fresh(docs, "secret_key"), fresh(docs, "secret_kinds"), fresh(docs, "secret_id")
    hits = hits.select(F.col("id").alias(number), F.col("key").alias(f"{key}_hit"), F.col("kinds").alias(kinds))
    rows = docs.withColumn(key, F.xxhash64(text))
    joined = rows.join(hits, (rows[key] == hits[f"{key}_hit"]) & docs["doc_id"].cast("string").eqNullSafe(hits[number]), "left")
    parts = []
    for i, rule in enumerate(rules):
        found = _spans(text, i, rule)
        parts.append(F.when(F.array_contains(F.col(kinds), rule.kind), found).otherwise(F.array().cast(SPANS)) if rule.kind in indexed else found)
    return joined.withColumn(name, F.array_sort(F.concat(*parts))).drop(key, f"{key}_hit", kinds, number)


def spans_name(docs: DataFrame) -> str:
    return fresh(docs, "secret_spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by its kind in brackets; overlapping spans become one, named by the first.

    Texts without secrets, null ones included, stay as they are; n_chars follows where the table has it. No row goes: repeated
    rows stay repeated, an empty table stays empty, and very long texts are redacted to their end.
    """
    spans = spans_name(docs)
    found = scan(docs, rules)
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        fits = x["start"] >= done["at"]
        piece = F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(fits, piece).otherwise(done["out"]).alias("out"))

    def finish(x: Column) -> Column:
        return F.concat(x["out"], F.substr(text, (x["at"] + 1).cast("int")))

    clean = F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, finish)).otherwise(text)
    name = fresh(found, "secret_clean")
    found = found.withColumn(name, clean)
    columns = []
    for c, kind in docs.dtypes:
        if c == "n_chars":
            columns.append(F.when(F.size(spans) > 0, F.char_length(name).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(name if c == "text" else c).alias(c))
    return found.select(*columns)


def digest_rows(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans and the digest of an empty list; rows repeated whole get the same row each, very long
    texts all their spans; an empty table gives no rows, and other columns aren't read.
    """
    spans = spans_name(docs)
    found = scan(docs)
    base = F.filter(F.col(spans), lambda x: x["kind_no"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("doc_id"), *map(count, ("assign", "access", "hex")), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))
