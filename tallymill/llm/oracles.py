"""DuckDB texts for the queries of this package that SQL can express."""

from __future__ import annotations

URLS = """
WITH rules(rh, rp, rv) AS (VALUES
    ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, row_number() OVER () AS row,
               CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
        FROM pages),
placed AS (SELECT page_id, row,
                  translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0, 's'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*', 0, 's')) + 1:],
                                 '^[^?#]*', 0, 's') AS path
           FROM cut),
best AS (SELECT row, first(rh || rp ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS rule,
                first(rv ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS verdict
         FROM placed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
         GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM placed LEFT JOIN best USING (row)
"""

QUALITY = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)),
                         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, array_to_string(words[i:i + 4], ' ') AS win
            FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
repeated AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM windows)
             WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words
            FROM repeated, unnest(range(0, 5)) AS t(k) GROUP BY row),
base AS (SELECT row, doc_id, source, len(words) AS n_words,
                length(array_to_string(words, '')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words
         FROM w LEFT JOIN covered USING (row)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::int) AS f FROM failed GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v = 0 THEN 1.0 ELSE greatest(m * (1 - m) / v - 1, 1.0) END AS weight
          FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
           SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM failed.source) AS kept
FROM failed
"""

LEAKS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
b AS (SELECT row_number() OVER () AS brow, item_id, regexp_extract_all(translate(text,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x20\\x09-\\x0D]+') AS words FROM benchmark),
ds AS (SELECT DISTINCT row, doc_id, array_to_string(words[i:i + 4], ' ') AS s
       FROM d, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
bs AS (SELECT DISTINCT brow, item_id, array_to_string(words[i:i + 4], ' ') AS s
       FROM b, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT brow, count(*) AS n FROM bs GROUP BY brow),
held AS (SELECT row, doc_id, brow, item_id, count(*) AS found FROM ds JOIN bs USING (s)
         GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS n_shingles, max(found) AS n_found
FROM held JOIN sizes USING (brow) WHERE found * 100 >= n * 80 GROUP BY doc_id, item_id
"""

COPIES = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
placed AS (SELECT doc_id, row, body, count(*) OVER (PARTITION BY body) AS group_size,
                  first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place
           FROM d WINDOW best AS (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM placed
"""

HARD = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id AS id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.row AS anchor, a.id AS anchor_id, b.row, b.id, a.label = b.label AS alike,
             CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.row <> b.row AND len(a.x) = len(b.x) WHERE a.id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, row) AS place
      FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
             s.score AS negative_score, row_number() OVER (
                 PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.id NULLS LAST, s.row) AS place
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike
          AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE place <= 3
"""


def all_sql() -> dict[str, str]:
    return {"op5_url_filter": URLS, "op6_quality_rules": QUALITY, "op8_decontaminate": LEAKS,
            "op11_exact_dedup": COPIES, "op13_hard_negatives": HARD}
