"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .licences import TEMPLATES, bounds, template_bigrams

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
     win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
     first AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (key) WHERE least < doc_id),
     lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
     kept AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, ws, ps FROM w LEFT JOIN lost USING (doc_id)),
     each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
     joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN joined USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
     e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
     pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
     reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON reach.r = pair.a)
SELECT s.doc_id, len(sh) AS n_shingles, least AS component_id FROM s JOIN (SELECT doc_id, min(r) AS least FROM reach GROUP BY doc_id) USING (doc_id)
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, source, text, {_WORDS.format("text")} AS ws FROM d),
     win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
     twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
     rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
     l AS (SELECT doc_id, source, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm, len({_WORDS.format("line")}) AS n FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE {_HAS_WORD}),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
     hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
     freq AS (SELECT l.source, norm FROM l JOIN hosts USING (source) GROUP BY l.source, norm, docs HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > docs * 0.02),
     gone AS (SELECT doc_id, count(*) AS n_frequent_lines, sum(n) AS lost FROM l JOIN freq ON l.source = freq.source AND l.norm = freq.norm GROUP BY doc_id),
     base AS (SELECT doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_frequent_lines, 0) AS n_frequent_lines, len(ws) - coalesce(lost, 0) AS words_left
              FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_frequent_lines > 0 AND (words_left < 10 OR words_left < 0.5 * n_words)) AS kept FROM base
"""


def _licences(threshold: float = 0.8) -> str:
    rows = []
    for i, (name, spdx, text) in enumerate(TEMPLATES):
        b = template_bigrams(text)
        lo, hi = bounds(len(b), threshold)
        rows.append(f"({i}, '{name}', '{spdx}', {len(b)}, {lo}, {hi}, [{', '.join(repr(x) for x in b)}])")
    return f"""
WITH t(i, template, licence, m, lo, hi, tb) AS (VALUES {", ".join(rows)}),
     u AS (SELECT rid, unnest(list_distinct([x] || regexp_split_to_array(x, '\\n[\\x20\\x09-\\x0D]*\\n') || string_split(x, chr(10)))) AS unit FROM (SELECT row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents)),
     ids AS (SELECT row_number() OVER () AS rid, doc_id FROM documents),
     w AS (SELECT rid, row_number() OVER () AS k, regexp_extract_all(lower(unit), '[a-z0-9]+') AS ws FROM u),
     b AS (SELECT rid, k, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ub FROM w WHERE len(ws) > 1),
     s AS (SELECT rid, k, i, template, licence, 2.0 * len(list_intersect(ub, tb)) / (len(ub) + m) AS score FROM b JOIN t ON len(ub) BETWEEN lo AND hi),
     best AS (SELECT * FROM s WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, i) = 1),
     per AS (SELECT rid, arg_max(licence, score * 1000000 - i) AS licence, arg_max(template, score * 1000000 - i) AS template, max(score) AS score, count(*) AS n_units, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM best GROUP BY rid)
SELECT doc_id, licence, template, coalesce(score, 0)::DOUBLE AS score, coalesce(n_units, 0) AS n_units, coalesce(licences, '') AS licences FROM ids LEFT JOIN per USING (rid)
"""


ORACLE_SQL = {name: " ".join(sql.split()) for name, sql in (("op2_substring", SUBSTRING), ("op5_ngram_join", NGRAM_JOIN), ("op8_licences", _licences()), ("op9_quality", QUALITY))}
