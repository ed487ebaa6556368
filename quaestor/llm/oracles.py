"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quaestor.llm.chat import CLOSE, CONTROL, OPEN
from quaestor.llm.quality_rules import STOP_FORMS

_STOP = ", ".join(f"'{w}'" for w in STOP_FORMS)


def _added(column: str) -> str:
    """By how many characters escaping lengthens a text: backslashes, and starts of control strings."""
    shortest = [c for c in CONTROL if not any(c != o and c.startswith(o) for o in CONTROL)]
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *shortest))


ORACLES = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT r, doc_id, list_sort(list_distinct([array_to_string(words[i:i + 2], ' ')
                   for i in range(1, greatest(len(words) - 1, 2))])) AS grams
            FROM w WHERE len(words) > 0),
        d AS (SELECT md5(array_to_string(grams, '  ')) AS id, any_value(grams) AS grams, min(doc_id) AS least FROM s GROUP BY 1),
        g AS (SELECT id, len(grams) AS n, unnest(grams) AS gram FROM d),
        links AS (
            SELECT a.id AS a, b.id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.id <> b.id
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (
            SELECT id AS a, id AS b FROM d
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT reach.a AS id, min(least) AS least FROM reach JOIN d ON d.id = reach.b GROUP BY 1)
        SELECT w.doc_id, coalesce(len(grams), 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
        FROM w LEFT JOIN s USING (r) LEFT JOIN c ON c.id = md5(array_to_string(grams, '  '))
    """,
    "op5_quality_rules": rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
            FROM t),
        five AS (
            SELECT r, i, array_to_string(words[i:i + 4], ' ') AS five
            FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
        starts AS (SELECT r, i FROM five QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
        covered AS (
            SELECT r, sum(c) AS c
            FROM (SELECT r, least(coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5), 5) AS c FROM starts) GROUP BY r),
        n AS (
            SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
                   len([x for x in words if x IN ({_STOP})]) AS n_stop_words,
                   len(regexp_extract_all(t, '\p{{Lu}}{{4,}}')) AS n_shouted
            FROM w LEFT JOIN covered USING (r)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n)
        SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
                  AND n_shouted / n_words <= 0.3 AND (n_words < 50 OR n_stop_words / n_words >= 0.02)
                  AND (n_lines < 4 OR n_dup_lines / n_lines <= 0.3) AS kept
        FROM b
    """,
    "op8_chat_formatting": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (
            SELECT *, {len(OPEN)} + length(role) + {_added("role")} + length(role) - length(replace(role, chr(10), '')) + 1
                      + length(text) + {_added("text")} + {len(CLOSE)} + 1 AS chars
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                               FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        f AS (SELECT page_id, t, strlen(t) AS bytes, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, bytes AS payload_bytes, sha256(t) AS payload_digest,
               CASE WHEN bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op13_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
            FROM documents),
        d AS (
            SELECT doc_id, text, tokens, len(tokens) AS n,
                   CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS k1,
                   CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS k2,
                   CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
            FROM t),
        c AS (
            SELECT doc_id, n, text,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(tokens[:least(k1, k2)], '') AS p,
                   array_to_string(tokens[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
                   array_to_string(tokens[greatest(k1, k2) + 1:], '') AS s
            FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c
    """,
}
