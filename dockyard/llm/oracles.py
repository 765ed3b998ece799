"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from dockyard.llm import host_rules
from dockyard.llm.secrets import RULES
from dockyard.llm.tables import LOWER, UPPER

NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

EXACT = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {NORMAL} AS t FROM documents)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(number: int) -> str:
    rule = RULES[number]
    pattern = _quoted(rule.pattern)
    return f"""
    SELECT doc_id, {number} AS kind_no, '{rule.kind}' AS kind, unnest(list_transform(range(len(m)), lambda i: struct_pack(
        s := list_sum(list_transform(g[1:i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0)::BIGINT,
        n := length(m[i + 1]), v := length(w[i + 1])))) AS x
    FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS w,
                 string_split_regex(text, {pattern}) AS g FROM documents WHERE text IS NOT NULL)"""


SECRETS = f"""
WITH spans AS (
    SELECT doc_id, kind_no, kind, x.s AS s, kind || ':' || x.s || ':' || (x.s + x.n) AS listed
    FROM ({" UNION ALL ".join(f"SELECT * FROM ({_spans(i)}) WHERE x.v >= {r.least}" for i, r in enumerate(RULES))})
), found AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex, string_agg(listed, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS base,
           string_agg(listed, ',' ORDER BY s, kind_no) AS listed
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(listed, '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

WORDS = r"list_filter(regexp_split_to_array(" + NORMAL + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS} AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s
    FROM words
), grams AS (
    SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links
FROM sets s
"""

_RAW_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_RATES = {r: f"((k_{r} + m_{r} * w_{r}) / (n + w_{r}))" for r in host_rules.RULES}


def _prior(rule: str) -> str:
    mean = f"(s_{rule}::DOUBLE / (h * {host_rules.UNITS})::DOUBLE)"
    spread = f"(t_{rule}::DOUBLE / (h * {host_rules.UNITS})::DOUBLE / {host_rules.UNITS}::DOUBLE - {mean} * {mean})"
    strongest = f"{host_rules.STRONGEST}::DOUBLE"
    weight = f"CASE WHEN {spread} > 0 THEN least(greatest({mean} * (1::DOUBLE - {mean}) / {spread} - 1::DOUBLE, {host_rules.WEAKEST}::DOUBLE), {strongest}) ELSE {strongest} END"
    return f"{mean} AS m_{rule}, {weight} AS w_{rule}"


HOSTS = f"""
WITH split AS (
    SELECT doc_id, nullif(regexp_extract(translate(coalesce(source, ''), '{UPPER}', '{LOWER}'), '{host_rules.HOST}', 1), '') AS host,
           {_RAW_WORDS} AS w, coalesce(text, '') AS t,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) > 4)
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)
    GROUP BY doc_id
), counts AS (
    SELECT s.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
    FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id
), hosts AS (
    SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({rule}) AS k_{r}" for r, rule in host_rules.RULES.items())}
    FROM counts WHERE host IS NOT NULL GROUP BY host
), sums AS (
    SELECT count(*) AS h, {", ".join(f"sum(({host_rules.UNITS} * k_{r}) // n) AS s_{r}, sum((({host_rules.UNITS} * k_{r}) // n)::HUGEINT * (({host_rules.UNITS} * k_{r}) // n)) AS t_{r}" for r in host_rules.RULES)}
    FROM hosts
), fitted AS (
    SELECT {", ".join(_prior(r) for r in host_rules.RULES)} FROM sums
), bad AS (
    SELECT host FROM hosts, fitted WHERE greatest({", ".join(_RATES.values())}) > {host_rules.LIMIT}::DOUBLE
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host, host_failed
FROM (SELECT *, ({") OR (".join(host_rules.RULES[r] for r in host_rules.BASE)}) AS base_failed, coalesce(host IN (SELECT host FROM bad), false) AS host_failed FROM counts)
"""


def _leaf(text: str) -> str:
    columns = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in columns) + ")"


_UP = "list_transform(range(0, len(a), 3), lambda i: sha256(array_to_string(a[i + 1:i + 3], '')))"
#: The siblings before and behind the node at place p (from 0) of a level a.
_BEFORE = "array_to_string(a[p - p % 3 + 1:p], '')"
_AFTER = "array_to_string(a[p + 2:p - p % 3 + 3], '')"


def _crc32(text: str) -> str:
    """crc32 of a short ASCII text, bit by bit."""
    shift = "lambda c, k: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    steps = f"lambda c, x: list_reduce(range(8), {shift}, xor(c, ascii(x)::UBIGINT))"
    return f"xor(list_reduce(string_split({text}, ''), {steps}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed,
           (row_number() OVER (PARTITION BY source ORDER BY doc_id)) - 1 AS p
    FROM documents
), trees(source, level, a) AS (
    SELECT source, 0, list(leaf ORDER BY doc_id) FROM leaves GROUP BY source
    UNION ALL SELECT source, level + 1, {_UP} FROM trees WHERE len(a) > 1
), subroots AS (
    SELECT source, a[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q FROM trees WHERE len(a) = 1
), top(level, a) AS (
    SELECT 0, list(subroot ORDER BY q) FROM subroots
    UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(a) > 1
), steps AS (
    SELECT doc_id, level, a, p // (3 ** level)::BIGINT AS p FROM (SELECT l.doc_id, t.level, t.a, l.p FROM leaves l JOIN trees t ON t.source IS NOT DISTINCT FROM l.source WHERE len(t.a) > 1)
    UNION ALL SELECT l.doc_id, 1000 + t.level, t.a, s.q // (3 ** t.level)::BIGINT
    FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, top t WHERE len(t.a) > 1
), sides AS (
    SELECT doc_id, level, {_BEFORE} AS b, {_AFTER} AS c FROM (SELECT doc_id, level, a, p::BIGINT AS p FROM steps)
), proofs AS (
    SELECT doc_id, list(struct_pack(b := b, c := c) ORDER BY level) AS w FROM sides GROUP BY doc_id
), folds(doc_id, i, d) AS (
    SELECT doc_id, 0, claimed FROM leaves
    UNION ALL SELECT f.doc_id, i + 1, sha256(w[i + 1].b || d || w[i + 1].c) FROM folds f JOIN proofs p ON p.doc_id = f.doc_id WHERE i < len(w)
), folded AS (
    SELECT doc_id, arg_max(d, i) AS d FROM folds GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT a[1] FROM top WHERE len(a) = 1) AS root,
       sha256(coalesce(array_to_string(list_transform(w, lambda x: x.b || x.c), ''), '')) AS proof_sha256, f.d AS folded_root,
       f.d = (SELECT a[1] FROM top WHERE len(a) = 1) AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN folded f ON f.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"

DIVERGENCE = f"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), occurring AS (
    SELECT DISTINCT lang, source FROM d
), words AS (
    SELECT doc_id, lang, source, translate(unnest(w), '{UPPER}', '{LOWER}') AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
), langs AS (
    SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
), totals AS (
    SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), dense AS (
    SELECT o.lang, o.source, k.term, coalesce(c.c, 0) AS c, k.c AS c_lang, l.n AS n_lang, coalesce(t.n, 0) AS n, l.v AS v
    FROM occurring o JOIN kept k ON k.lang = o.lang JOIN langs l ON l.lang = o.lang
    LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term LEFT JOIN totals t ON t.lang = o.lang AND t.source = o.source
), shares AS (
    SELECT *, {_SHARE.format(n="c", total="n")} AS p, {_SHARE.format(n="c_lang", total="n_lang")} AS q FROM dense
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM occurring a JOIN occurring b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms QUALIFY rank <= 200
"""

ORACLES = {
    "op1_exact_dedup": EXACT, "op4_secret_scans": SECRETS, "op5_ngram_jaccard": JACCARD, "op11_host_rules": HOSTS, "op12_merkle_manifest": MERKLE,
    "op13_source_divergence": DIVERGENCE,
}
