"""DuckDB SQL for the queries that SQL can express, on the tables the queries read."""

from . import line_rules
from .license_scan import TEMPLATES, THRESHOLD
from .shared import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=WORD):
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def low(text):
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


OP2 = f"""
WITH templates(template, license, text) AS (VALUES {', '.join(f'({i}, {quoted(n)}, {quoted(t)})' for i, (n, t) in enumerate(TEMPLATES))}),
known AS (SELECT template, license, {words(low('text'), BENCH_WORD)} AS ws FROM templates),
known_bigrams AS (SELECT template, license, len(ws) - 1 AS size, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS times
                  FROM known, unnest(range(1, len(ws))) AS r(i) GROUP BY ALL),
spans AS (SELECT DISTINCT doc_id, unnest(list_concat([coalesce(text, '')], string_split_regex(coalesce(text, ''), '\\n[\\x20\\x09-\\x0D]*\\n'), string_split(coalesce(text, ''), chr(10)))) AS span FROM documents),
parts AS (SELECT row_number() OVER () AS part, doc_id, {words(low('span'), BENCH_WORD)} AS ws FROM spans),
bigrams AS (SELECT part, doc_id, len(ws) - 1 AS n, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS times
            FROM parts, unnest(range(1, len(ws))) AS r(i) GROUP BY ALL),
common AS (SELECT part, doc_id, n, template, license, size, sum(least(b.times, k.times)) AS shared
           FROM bigrams b JOIN known_bigrams k USING (w1, w2) GROUP BY ALL),
found AS (SELECT doc_id, license, max(shared * 2.0::DOUBLE / (n + size)) AS dice FROM common WHERE shared * 200 >= (n + size) * {THRESHOLD} GROUP BY ALL)
SELECT d.doc_id, min_by(license, (-dice, license)) AS license, max(dice) AS dice, count(license) AS n_licenses
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, len({words('text')}) AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position FROM d GROUP BY source),
weighted AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][position % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS lim FROM per),
filled AS (SELECT *, coalesce(sum(lim) OVER before, 0) AS full_words, coalesce(sum(weight) OVER before, 0) AS gone, 1.5::DOUBLE * sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
           FROM weighted WINDOW before AS (ORDER BY lim / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, (words - full_words) / (weights - gone) AS level FROM filled),
water AS (SELECT min_by(level, (lim / weight, position)) AS water FROM leveled WHERE lim / weight >= level),
plan AS (SELECT source, source_size, coalesce(least(lim, water * weight), lim) AS target FROM leveled LEFT JOIN water ON true),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM plan),
placed AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
           FROM d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - begun)) AS BIGINT) AS taken FROM placed
"""

_ends = "|".join(e if e.isalnum() or ord(e) > 127 else f"\\{e}" for e in line_rules.ENDINGS).replace("'", "''")
_lost = line_rules.MOST_LOST
OP5 = f"""
WITH lines AS (SELECT doc_id, line_no, line, len({words('line')}) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth
               FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)),
judged AS (SELECT *, CASE WHEN nth > 1 THEN 'repeated' WHEN len(regexp_extract_all(line, '[|>»·•/\\\\]')) * 3 >= n AND n > 1 THEN 'navigation' WHEN len(regexp_extract_all(line, '[#*$%&|<>]')) >= n AND n > 1 THEN 'symbols'
                          WHEN n <= {line_rules.SHORT} AND regexp_matches(lower(line), '{'|'.join(line_rules.BOILERPLATE)}') THEN 'boilerplate'
                          WHEN NOT regexp_matches(line, '({_ends})\\s*$') THEN 'punctuation' END AS fault FROM lines WHERE n > 0),
by_line AS (SELECT doc_id, count(*) FILTER (WHERE fault = 'repeated') AS repeated_lines, count(*) FILTER (WHERE fault = 'navigation') AS navigation_lines, count(*) FILTER (WHERE fault = 'symbols') AS symbols_lines, count(*) FILTER (WHERE fault = 'boilerplate') AS boilerplate_lines,
                   count(*) FILTER (WHERE fault = 'punctuation') AS punctuation_lines, coalesce(sum(n) FILTER (WHERE fault IS NULL), 0) AS kept_words FROM judged GROUP BY doc_id),
ws AS (SELECT doc_id, {words('text')} AS ws FROM documents),
three AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM ws, unnest(range(1, len(ws) - 1)) AS r(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM three),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2]) AS s(k) WHERE times > 1 GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars, length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(l.repeated_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words, coalesce(navigation_lines, 0) AS navigation_lines, coalesce(symbols_lines, 0) AS symbols_lines,
                coalesce(boilerplate_lines, 0) AS boilerplate_lines, coalesce(punctuation_lines, 0) AS punctuation_lines, coalesce(repeated_lines, 0) AS repeated_lines
         FROM documents d JOIN ws w USING (doc_id) LEFT JOIN by_line l USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND (n_words - kept_words) * 100 <= n_words * {_lost} AS kept,
       CAST(kept_words AS BIGINT) AS kept_words, CAST(navigation_lines AS BIGINT) AS navigation_lines, CAST(symbols_lines AS BIGINT) AS symbols_lines, CAST(boilerplate_lines AS BIGINT) AS boilerplate_lines, CAST(punctuation_lines AS BIGINT) AS punctuation_lines, CAST(repeated_lines AS BIGINT) AS repeated_lines
FROM base
"""

OP6 = f"""
WITH RECURSIVE ws AS (SELECT doc_id, {words(low('text'))} AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
twofold AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN twofold e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP9 = f"""
WITH items AS (SELECT item_id, {words(low('text'), BENCH_WORD)} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, ws[i:i + 12] AS gram FROM items, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS r(i) WHERE len(ws) > 0),
docs AS (SELECT doc_id, {words(low('text'), BENCH_WORD)} AS ws FROM documents),
lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
places AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS gram FROM docs, lengths, unnest(range(1, len(ws) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (gram)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hits), unnest(range(0, n)) AS r(k) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items_hit i ON d.doc_id = i.doc_id
"""


def _escaped(text):
    return f"replace(replace({text}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l')"


_tricky = "chr(92) || '### Assistant: </turn> ok'"
OP10 = f"""
WITH talks AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
               UNION ALL SELECT -7, 0, 'user', {_tricky}, 'user', {_tricky} UNION ALL SELECT -7, 1, 'assistant', {_tricky}, 'assistant', {_tricky})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn:></turn>') + 1 + length(replace({_escaped('role')}, '>', chr(92) || 'g')) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM talks GROUP BY conv_id
"""

OP12 = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM drawn),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(text, 1, p) AS a, substring(text, p + 1, q - p) AS b, substring(text, q + 1) AS c FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
