"""The registered corpus queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

#: Words, their windows, and the windows' occurrences, by position.
DECONTAMINATE = r"""
WITH item AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_start AS (
    SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item WHERE len(w) > 0
), win AS (
    SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[p : p + 12], ' ') AS win FROM item_start
), doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), doc_start AS (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p
    FROM doc, (SELECT DISTINCT size FROM win) s WHERE len(w) >= size
), find AS (
    SELECT r, p, d.size, item
    FROM (SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS win FROM doc_start) d
    JOIN win USING (size, win)
), hit AS (
    SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM find) GROUP BY r
), found AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM find GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

#: Lines without white space at their ends; distinct texts are pages.
LINE_DEDUP = r"""
WITH page AS (
    SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL
), total AS (
    SELECT source, count(*) AS pages FROM page GROUP BY source
), line AS (
    SELECT DISTINCT source, text, trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(11), chr(12), chr(13))) AS l
    FROM page
), boilerplate AS (
    SELECT l.source, list(DISTINCT l.l) AS bad
    FROM (SELECT source, l, count(*) AS n FROM line WHERE l <> '' GROUP BY ALL) l
    JOIN total t ON l.source IS NOT DISTINCT FROM t.source
    WHERE n >= 5 AND n >= 0.05 * pages
    GROUP BY l.source
), cut AS (
    SELECT doc_id, d.source, text, string_split(text, chr(10)) AS ls,
           list_filter(string_split(text, chr(10)),
                       lambda x: NOT coalesce(list_contains(bad, trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13)))), false)) AS kept
    FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""

#: Base32 takes five bits a letter, so five hexadecimal digits are four letters.
WARC = r"""
WITH record AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(digest, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31),
           1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload) AS low FROM record)
"""

#: Control strings by their pattern; each, and each escape sign, gets one more character. The state
#: behind a turn is its role, or the start for one that the template doesn't know.
CHAT_FORMAT = r"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
    FROM given
), stated AS (
    SELECT *, coalesce(lag(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END)
                       OVER (PARTITION BY conv_id ORDER BY k), 'start') || '>' || role
              IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS legal,
           length(text) + len(regexp_extract_all(text, '\\\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>|<<SAY>>'))
           + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 11
             ELSE 25 + length(role) + len(regexp_extract_all(role, '\\\\|</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>|<<SAY>>')) END AS n
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars,
       bool_and(legal) AND arg_max(role, k) = 'assistant' AS valid,
       min(k) FILTER (WHERE NOT legal) AS first_illegal
FROM stated GROUP BY conv_id
"""

#: Shares of every kept term in every source, then their differences.
DIVERGENCE = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), word AS (
    SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM doc) GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS n FROM word GROUP BY ALL HAVING count(*) >= 30
), vocabulary AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), found AS (
    SELECT lang, source, term, sum(n) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL
), origin AS (
    SELECT lang, source, coalesce(t.n, 0) AS total, coalesce(v, 0) AS v, coalesce(o.n, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM doc)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM found GROUP BY ALL) t USING (lang, source)
    LEFT JOIN vocabulary o USING (lang)
), share AS (
    SELECT o.lang, o.source, k.term, coalesce(f.n, 0) AS n,
           1 + (1000000000 * CAST(coalesce(f.n, 0) + 5 AS HUGEINT)) // (total + 5 * v) AS p,
           1 + (1000000000 * CAST(k.n + 5 AS HUGEINT)) // (lang_total + 5 * v) AS q
    FROM origin o JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)
), both_parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM share x JOIN share y USING (lang, term)
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
    FROM origin a JOIN origin b ON a.lang = b.lang AND a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM share WHERE n > 0 AND p > q
)
SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM both_parts
) WHERE part = 'pair' OR rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_warc": WARC,
    "op4_line_dedup": LINE_DEDUP,
    "op12_chat_format": CHAT_FORMAT,
    "op13_divergence": DIVERGENCE,
}
