"""What some of the queries return, said in DuckDB SQL; used to check them and nowhere else."""

from __future__ import annotations

import string

FOLDED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
BLANKS = r"[ \t\n\x0B\f\r]"
WORDS = r"[^ \t\n\x0B\f\r]+"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
placed AS (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized),
wanted AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM placed),
sizes AS (SELECT DISTINCT size FROM wanted),
starts AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size),
here AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM starts),
found AS (SELECT doc_id, here.size AS size, i, item_id FROM here JOIN wanted ON here.size = wanted.size AND here.k = wanted.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORDS}') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM placed),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT s.doc_id AS doc_id, k, n FROM s JOIN n ON s.doc_id = n.doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM sized a JOIN sized b ON a.k = b.k
        WHERE a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 90 * (na + nb - shared)),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(y), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN reach ON d.doc_id = reach.x GROUP BY d.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM placed),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM again WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT doc_id, unnest(split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
m AS (SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '{BLANKS}', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(lines.n, 0) AS n_lines,
             coalesce(lines.n - lines.kinds, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, regexp_matches(t, '\p{{L}}') AS letters
      FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * word_chars OR (n_words > 0 AND word_chars < 2 * n_words)
            OR word_chars > 25 * n_words OR (n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines) OR (n_words > 0 AND NOT letters)) AS kept
FROM m
"""

_CONTROL = r"(/?s>|sep>|/?ROLE\]|/?INST\]|</?SYS>>)"


def _escaped(column: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({column}, '&', '&amp;'), '<{_CONTROL}', '&lt;\1', 'g'), '\[{_CONTROL}', '&#91;\1', 'g')"


OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS earlier, lead(role) OVER w AS later
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
       CAST(sum(CASE WHEN earlier IS NULL OR earlier <> role THEN 16 + length({_escaped("role")}) ELSE 5 END + length({_escaped("text")})
                + CASE WHEN later IS NULL OR later <> role THEN 4 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

SQL = {
    "op3_decontamination": OP3,
    "op4_warc": OP4,
    "op5_jaccard_join": OP5,
    "op9_quality_rules": OP9,
    "op10_chat_format": OP10,
}
