"""SQL that gives the same results as the queries, where SQL can.

Licence scan (weights from corpus statistics over template alignments), classifier,
decontamination, token output and token counts have none: they are tested against brute
force, a held-out part and an exact round trip.
"""

from __future__ import annotations

from . import filter_audit as audit
from . import quality_rules as rules
from . import secret_scan, spelling
from .queries import URL_RULES
from .warc import ALPHABET

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = f"'{AZ}', '{AZ.lower()}'"
SPACE, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"


def _url_filter() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS a FROM pages),
q AS (SELECT page_id, CASE WHEN a > 0 THEN substr(u, a + 3) ELSE '' END AS r FROM p),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), {LOWER}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
rules(rh, rp, verdict) AS (VALUES {values}),
m AS (SELECT h.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS rn
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1"""


def _quality_rules() -> str:
    classes, left, cuts = [], "joined", []
    for name, pattern in rules.CLASSES.items():
        p = pattern.replace("'", "''")
        cuts.append(f"s_{name} AS (SELECT *, regexp_replace({left}, '{p}', '', 'g') AS a_{name} FROM {'s' if left == 'joined' else 's_' + left[2:]})")
        classes.append(f"length({left}) - length(a_{name}) AS c_{name}")
        left = f"a_{name}"
    last = "s_" + left[2:]
    names = [f"c_{c}" for c in (*rules.CLASSES, "other")]
    words = []
    n = max(map(len, rules.COMMON_WORDS.values()))
    for k in range(n):
        whens = " ".join(f"WHEN '{lang}' THEN len(list_filter(ws, lambda x: lower(x) = '{w[k]}'))" for lang, w in rules.COMMON_WORDS.items())
        words.append(f"CASE lang {whens} ELSE 0 END AS w_{k}")
    wn = [f"w_{k}" for k in range(n)]
    term = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2({b} / (({a} + {b}) / 2)) ELSE 0 END) / 2"
    js_c = " + ".join(term(f"({c}::DOUBLE / cn)", f"(r_{c}::DOUBLE / r_cn)") for c in names)
    rest_p, rest_q = "((n_words - wn)::DOUBLE / n_words)", "((r_n_words - r_wn)::DOUBLE / r_n_words)"
    js_w = " + ".join([*(term(f"({w}::DOUBLE / n_words)", f"(r_{w}::DOUBLE / r_n_words)") for w in wn), term(rest_p, rest_q)])
    langs = ", ".join(f"'{x}'" for x in rules.COMMON_WORDS)
    sums = ", ".join(f"sum({c}) AS r_{c}" for c in (*names, *wn, "n_words"))
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws, regexp_replace(text, '{SPACE}', '', 'g') AS joined,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
{", ".join(cuts)},
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
t AS (SELECT s.doc_id, lang, len(ws) AS n_words, length(joined) AS word_chars, len(regexp_extract_all(text, '{rules.SYMBOLS}')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, {", ".join(classes)}, length({left}) AS c_other, {", ".join(words)}
  FROM {last} s LEFT JOIN rep USING (doc_id)),
u AS (SELECT *, {" + ".join(names)} AS cn, {" + ".join(wn)} AS wn FROM t),
per AS (SELECT lang, {sums} FROM u GROUP BY 1), al AS (SELECT {sums} FROM u),
ref AS (SELECT * FROM per WHERE lang <> '' UNION ALL SELECT '', * FROM al),
ref2 AS (SELECT *, {" + ".join("r_" + c for c in names)} AS r_cn, {" + ".join("r_" + w for w in wn)} AS r_wn FROM ref),
j AS (SELECT u.*, CASE WHEN cn > 0 AND r_cn > 0 THEN sqrt(greatest(0, {js_c})) END AS jc, CASE WHEN n_words > 0 AND r_n_words > 0 AND u.lang <> '' THEN sqrt(greatest(0, {js_w})) END AS jw FROM u JOIN ref2 USING (lang)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {rules.MIN_CHARS} AND n_words >= {rules.MIN_WORDS} AND (coalesce(jc > {rules.MAX_CLASS_DISTANCE}, false) OR coalesce(jw > {rules.MAX_WORD_DISTANCE}, false))) AS kept,
  round(jc, 4) AS js_classes, round(jw, 4) AS js_words FROM b"""


NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _secret_scan() -> str:
    parts = []
    for rank, k in enumerate(secret_scan.KINDS):
        p = k.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, source, '{k.name}' AS kind, {rank} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'n': length(m[i]), 'v': v[i]}})) AS x
  FROM (SELECT doc_id, source, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {k.group}) AS v FROM d)""")
    least = " ".join(f"WHEN '{k.name}' THEN {k.least}" for k in secret_scan.KINDS)
    base = ", ".join(f"'{k.name}'" for k in secret_scan.BASE_KINDS)
    line = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
h AS (SELECT doc_id, source, kind, rank, x.s AS s, x.s + x.n AS e, x.v AS v FROM f WHERE length(x.v) >= CASE kind {least} END),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM h GROUP BY 1),
lim AS (SELECT least({secret_scan.MIN_OWNERS}, greatest({secret_scan.LEAST_OWNERS}, CAST(ceil(count(DISTINCT coalesce(source, chr(0))) / 2.0) AS BIGINT))) AS lim FROM documents),
judged AS (SELECT doc_id, count(*) FILTER (owners < (SELECT lim FROM lim)) AS n_live, count(*) FILTER (owners >= (SELECT lim FROM lim)) AS n_copied FROM (SELECT DISTINCT doc_id, v FROM h) JOIN own USING (v) GROUP BY 1),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({line}, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base, string_agg({line}, ',' ORDER BY s, rank) AS spans FROM h GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (doc_id) LEFT JOIN judged USING (doc_id)"""


MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|mix-1') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, source_size / weight AS ratio, sum(weight) OVER () AS weights,
  coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
  coalesce(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w),
l AS (SELECT *, (budget - 2 * full_size) / (weights - gone) AS level FROM o),
best AS (SELECT level FROM l WHERE level <= 2 * ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM best) * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM e"""

_DIGITS = " || ".join(f"substr('{ALPHABET}', CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {15 - 5 * k}) % 32 + 1 AS BIGINT), 1)" for i in range(8) for k in range(4))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM q"""


#: CRC-32 bit by bit makes the table of its 256 bytes; a run's bytes are folded over it.
SPELLING = f"""
WITH RECURSIVE bit(b, k, c) AS (SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8),
d AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{spelling.MIN_LENGTH},}}')) AS raw FROM documents),
o AS (SELECT doc, run, hex(encode(doc || ':' || run)) AS x FROM (SELECT DISTINCT doc, translate(raw, {LOWER}) AS run FROM d)),
h AS (SELECT doc, run, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) % 256 + 1 AS BIGINT)])), 4294967295) AS h FROM o, crc),
w AS (SELECT doc, run, CASE WHEN h % {spelling.DELETE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM h),
p AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{spelling.MIN_LENGTH},}}')), {LOWER}) AS run FROM documents),
v AS (SELECT word, count(*) AS n FROM p JOIN w USING (doc, run) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY 1 HAVING count(*) >= {spelling.MIN_PLACES}),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT DISTINCT word, near FROM (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION ALL SELECT c.word, v.word FROM cut c JOIN v ON c.less = v.word UNION ALL SELECT v.word, c.word FROM cut c JOIN v ON c.less = v.word)),
best AS (SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS k FROM near JOIN v ON v.word = near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
chain(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.form)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL"""


def _filter_audit() -> str:
    n, names = len(audit.FILTERS), audit.FILTERS
    bits = " + ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate((
        f"len(ws) < {audit.MIN_WORDS}", f"100 * len(list_distinct(ws)) < {audit.DISTINCT_PERCENT} * len(ws)", f"100 * len(regexp_extract_all(text, '[A-Z]')) > {audit.CAPITAL_PERCENT} * length(text)",
        f"regexp_matches(text, '{audit.MARKS}')", "coalesce(doc_id > first_id, false)")))
    letters = ", ".join(f"({i}, '{c}')" for i, c in enumerate(names))
    steps = range(1, n + 1)
    differ = " AND ".join(f"l{a}.f <> l{b}.f" for a in steps for b in steps if a < b)
    before = " + ".join(f"(CASE WHEN step > {a} THEN 1 << l{a}.i ELSE 0 END)" for a in steps)
    return f"""
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
m AS (SELECT doc_id, part, {bits} AS mask FROM e),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letter(i, f) AS (VALUES {letters}),
o AS (SELECT {" || ".join(f"l{a}.f" for a in steps)} AS filter_order, step, CASE step {" ".join(f"WHEN {a} THEN 1 << l{a}.i" for a in steps)} END AS own, {before} AS before
  FROM {", ".join(f"letter l{a}" for a in steps)}, (SELECT unnest(range(1, {n + 1})) AS step) WHERE {differ}),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, o GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    found = {
        "op2_url_filter": _url_filter(),
        "op4_quality_rules": _quality_rules(),
        "op5_near_dedup": NEAR_DEDUP,
        "op6_secret_scan": _secret_scan(),
        "op8_mixing": MIXING,
        "op9_warc": WARC,
        "op12_spelling_variants": SPELLING,
        "op13_filter_audit": _filter_audit(),
    }
    return {k: v.strip() for k, v in found.items()}
