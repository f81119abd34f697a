"""Oracle SQL (DuckDB) of the queries in ``catalog``."""

from __future__ import annotations

from .disclosure import KINDS
from .license_rules import LEVELS, PHRASES, RULES, worded
from .licenses import NO_WORD, PHRASE_SCORE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "[\\x20\\x09-\\x0D]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda x: x <> '')"


LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
worded AS (SELECT doc_id, line_no, line, {words("lower(line)")} AS w FROM lines),
occ AS (SELECT doc_id, line_no, w, len(w) AS n FROM worded WHERE len(w) >= 4),
firsts AS (
  SELECT row_number() OVER (ORDER BY f.doc_id, f.line_no) AS place, w, n, f.doc_id AS doc_id, f.line_no AS line_no
  FROM (SELECT w, any_value(n) AS n, min({{'doc_id': doc_id, 'line_no': line_no}}) AS f FROM occ GROUP BY w)),
halves AS (
  SELECT place, w, n, m, unnest([hash('head', m, w[1:m // 2]), hash('tail', m, w[n - (m - m // 2) + 1:n])]) AS half
  FROM (SELECT place, w, n, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 10)),
pairs AS (
  SELECT DISTINCT a.place AS a, b.place AS b, a.w AS aw, b.w AS bw, a.n AS an, b.n AS bn
  FROM halves a JOIN halves b ON a.half = b.half AND a.place < b.place AND abs(a.n - b.n) <= 1),
near AS (
  SELECT DISTINCT b AS place FROM pairs
  WHERE CASE WHEN an = bn THEN len(list_filter(range(1, an + 1), lambda i: aw[i] <> bw[i])) <= 1
        WHEN an > bn THEN len(list_filter(range(1, an + 1), lambda i: list_concat(aw[1:i - 1], aw[i + 1:an]) = bw)) > 0
        ELSE len(list_filter(range(1, bn + 1), lambda i: list_concat(bw[1:i - 1], bw[i + 1:bn]) = aw)) > 0 END),
marked AS (
  SELECT o.doc_id, o.line_no, (o.doc_id, o.line_no) = (f.doc_id, f.line_no) AS is_first, r.place IS NOT NULL AS is_near
  FROM occ o JOIN firsts f USING (w) LEFT JOIN near r ON r.place = f.place),
per_line AS (SELECT l.doc_id, l.line_no, l.line, coalesce(NOT m.is_first, false) AS exact, coalesce(m.is_first AND m.is_near, false) AS near
             FROM lines l LEFT JOIN marked m USING (doc_id, line_no))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT exact AND NOT near), '') AS text
FROM per_line GROUP BY doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [md5(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM either UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN roots r ON r.a = d.doc_id
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h:' || source, '-') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, md5(text) AS k, {words("text")} AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, range(5) t(j) GROUP BY rid),
lines AS (SELECT rid, doc_id, host, k, line, {words(f"translate(line, '{UPPER}', '{LOWER}')")} AS lw
          FROM (SELECT rid, doc_id, host, k, unnest(string_split(text, chr(10))) AS line FROM w)),
full_lines AS (SELECT rid, doc_id, host, k, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT k) AS docs FROM w GROUP BY host),
frequent AS (
  SELECT host, norm, holder FROM (SELECT host, norm, count(DISTINCT k) AS docs, min(doc_id) AS holder FROM full_lines GROUP BY ALL) f
  JOIN hosts h USING (host) WHERE f.docs > 20 AND f.docs > 0.01 * h.docs),
firsts AS (SELECT host, k, min(doc_id) AS first_id FROM w GROUP BY ALL),
lost AS (SELECT rid, sum(n)::BIGINT AS lost FROM full_lines JOIN frequent USING (host, norm) JOIN firsts USING (host, k)
         WHERE first_id IS DISTINCT FROM holder GROUP BY rid),
base AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(lost, 0) AS boilerplate_words
  FROM w LEFT JOIN covered c USING (rid) LEFT JOIN dups u USING (rid) LEFT JOIN lost USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, boilerplate_words,
  NOT base_failed AND n_words - boilerplate_words >= 0.2 * n_words AS kept
FROM judged
"""

CHAT = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
    replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'), chr(10), '&#10;') AS name FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || name || '|>' || chr(10) || body || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SHARDS = """
WITH steps AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, _:
                 CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM steps),
d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS key,
    hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, size, key, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2),
      lambda i: ('0x' || substr(h, i, 2))::UBIGINT)), lambda c, b: xor(v[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, tab),
m AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY key) AS own,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS nth FROM crc),
g AS (SELECT *, max(upto) OVER (PARTITION BY key) AS group_end FROM m),
p AS (
  SELECT doc_id, size, text_crc32, nth, least(23, ((CASE WHEN own * 24 * 50 <= total THEN 2 * group_end - own ELSE 2 * upto - size END)::HUGEINT
    * 24 // (2 * total)::HUGEINT))::INTEGER AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM p
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT page_id, body, sha1(body) AS h, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS nth,
        max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to
FROM t
"""

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
_RE = {"email": _EMAIL, "ip": "[0-9]+(?:\\.[0-9]+){3}", "card": "[0-9](?:[\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]"}
_TERM = "\\p{L}{4,}"
_OK = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(right(x, 4) AS INTEGER) > 255)) = 0",
    "card": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND luhn(regexp_replace(v, '[^0-9]', '', 'g')) % 10 = 0",
    "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
}
_OK["card"] = _OK["card"].replace("luhn(regexp_replace(v, '[^0-9]', '', 'g'))", (
    "list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda x, i: "
    "CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER > 4 THEN 2 * x::INTEGER - 9 ELSE 2 * x::INTEGER END))"))


def _spans(kind: str) -> str:
    """Matches of a kind with their places: lengths of the gaps and matches before each."""
    return f"""
  SELECT rid, {KINDS.index(kind)} AS k, '{kind}' AS kind, s AS start, s + length(v) AS stop, v FROM (
    SELECT rid, vs[i] AS v, (list_sum(list_transform(gs[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT rid, gs, vs, unnest(range(1, len(vs) + 1)) AS i FROM (
      SELECT rid, string_split_regex(text, '{_RE[kind]}') AS gs, regexp_extract_all(text, '{_RE[kind]}') AS vs FROM d)))
  WHERE {_OK[kind]}"""


PII = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_spans(k) for k in KINDS)}),
around AS (
  SELECT b.rid, k || ':' || lower(v) AS entity, start, stop, greatest(start - 60, 0) AS first, least(stop + 60, length(text)) AS last, length(text) AS size,
    substring(text, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0)) AS before,
    substring(text, stop + 1, least(stop + 60, length(text)) - stop) AS after FROM base b JOIN d USING (rid)),
sides AS (SELECT rid, entity, first, last, size, md5(before || chr(0) || after) AS context, first AS base_at, before AS part FROM around
          UNION ALL SELECT rid, entity, first, last, size, md5(before || chr(0) || after), stop, after FROM around),
found AS (
  SELECT rid, entity, context, first, last, size, lower(vs[i]) AS term, (base_at + list_sum(list_transform(gs[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(vs[i]) AS n
  FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM (
    SELECT *, string_split_regex(part, '{_TERM}') AS gs, regexp_extract_all(part, '{_TERM}') AS vs FROM sides))),
terms AS (
  SELECT DISTINCT rid, entity, context, term, start, start + n AS stop FROM found f
  WHERE (start > first OR first = 0) AND (start + n < last OR last = size)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b.start < f.start + f.n AND f.start < b.stop)),
pairs AS (SELECT entity, term, count(DISTINCT rid) AS n_both, count(DISTINCT context) AS shown FROM terms GROUP BY ALL HAVING count(DISTINCT context) >= 3),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT rid, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM d) GROUP BY term),
n_entity AS (SELECT entity, count(DISTINCT rid) AS n_entity FROM terms GROUP BY entity),
total AS (SELECT count(*) AS n FROM d),
bad AS (SELECT entity, term FROM pairs JOIN n_term USING (term) JOIN n_entity USING (entity), total
        WHERE n_entity < n AND 1 + log2(n_both / n_term) / -log2(n_entity / n) >= 0.8),
spans AS (
  SELECT rid, k, kind, start, stop FROM base
  UNION ALL SELECT DISTINCT rid, 4, 'term', start, stop FROM terms JOIN bad USING (entity, term)),
made AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN made USING (rid)
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ",\n".join(
    [f"({r.number}, {quoted(r.keyword)}, {r.level}, {quoted(r.label)}, {quoted(f' (?:{r.pattern}) ')})" for r in RULES]
    + [f"({-1 - k}, {quoted(worded(p))}, 0, {quoted(label)}, {quoted(f' {worded(p)} ')})" for k, (p, label) in enumerate(PHRASES.items())])

LICENCES = f"""
WITH rules(number, keyword, level, label, pattern) AS (VALUES {_RULES}),
d AS (
  SELECT doc_id, r, CASE WHEN b = '' THEN '' ELSE ' ' || b || ' ' END AS t FROM (
    SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_WORD}', '  ', 'g')) AS b
    FROM documents)),
sized AS (SELECT doc_id, r, t, (length(t) - length(replace(t, ' ', ''))) // 2 AS n_words FROM d),
hits AS (
  SELECT r, number, level, label,
         list_transform(string_split_regex(t, pattern), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS gaps,
         list_transform(regexp_extract_all(t, pattern), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS sizes
  FROM sized JOIN rules ON contains(t, keyword) WHERE regexp_matches(t, pattern)),
each AS (SELECT r, number, level, label, gaps, sizes, unnest(range(1, len(sizes) + 1)) AS k FROM hits),
placed AS (
  SELECT r, number, level, label, list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k - 1]), 0) AS a,
         list_sum(gaps[1:k]) + list_sum(sizes[1:k]) AS b FROM each),
kept AS (
  SELECT * FROM placed p WHERE level = 0 OR NOT EXISTS (
    SELECT 1 FROM placed q WHERE q.r = p.r AND q.level >= p.level AND q.a <= p.a AND q.b >= p.b
      AND ((q.a, q.b) <> (p.a, p.b) OR q.level > p.level OR q.number < p.number))),
per_row AS (
  SELECT r, count(*) FILTER (level = 0) AS n_base, min(a) FILTER (level = 0) AS first_word, max(a) FILTER (level = 0) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (level = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CASE level {' '.join(f'WHEN {k} THEN {c!r}::DOUBLE' for k, c in {**LEVELS, 0: PHRASE_SCORE}.items())} END) AS score,
         string_agg(DISTINCT number::VARCHAR, ',' ORDER BY lpad(number::VARCHAR, 4, '0')) FILTER (level > 0) AS rules
  FROM kept GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(rules, '') AS rules
FROM sized LEFT JOIN per_row USING (r)
"""

AUDIT = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS ws FROM documents),
f AS (
  SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS failed FROM w),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (
  SELECT o, step, 1 << (ascii(o[step]) - 65) AS own, list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65)))::INT AS gone
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)),
counted AS (
  SELECT part, o, step, own, sum(CASE WHEN failed & (gone | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed & gone = 0 AND failed & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed & gone > 0 AND failed & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & gone = 0 AND failed & own > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & gone = 0 AND failed & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SEARCH = f"""
WITH t AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
tf AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT r, count(*) AS n FROM t GROUP BY r),
tot AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id,
         sum(times * floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN len USING (r), tot GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
