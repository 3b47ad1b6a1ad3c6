"""DuckDB SQL for the operators whose results SQL can express, built from the same parameters as the operators."""

from __future__ import annotations

from . import license_scan

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql(*, containment: float = 0.9) -> str:
    """Every block against every template by plain intersection, every phrase at every place."""
    known = license_scan.templates_of(license_scan.TEMPLATES, license_scan.PHRASES, containment)
    step = license_scan.step_of(known, None)
    block = step + max(len(t.words) for t in known)
    notices = ", ".join(f"('{t.label}', {_list(sorted(set(t.words)))}, {license_scan.words_needed(t)})" for t in known if not t.phrase)
    phrases = ", ".join(f"('{t.label}', {_list(t.words)})" for t in known if t.phrase)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
notices(label, own, need) AS (VALUES {notices}),
phrases(label, own) AS (VALUES {phrases}),
blocks AS (SELECT r, w[k + 1:k + {block}] AS w FROM (SELECT r, w, unnest(range(0, len(w), {step})) AS k FROM d)),
met AS (SELECT r, label, n / len(own) AS share FROM (SELECT r, label, own, need, len(list_intersect(own, w)) AS n FROM blocks, notices) WHERE n >= need),
places AS (SELECT r, label, place FROM (SELECT r, label, own, w, unnest(range(0, len(w) - len(own) + 1)) AS place FROM d, phrases WHERE len(w) >= len(own)) WHERE w[place + 1:place + len(own)] = own),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT r, label, share FROM met UNION ALL SELECT r, label, 1.0::DOUBLE FROM places) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""


def line_sql(*, depth: int = 4, min_docs: int = 2, percent: int = 70, constant_percent: int = 10, short_tokens: int = 5, short_min_docs: int = 5) -> str:
    """The template tree as groupings: leaves by token count and leading tokens, constants by leaf, place, token and neighbours."""
    return rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, place, line, list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM l),
lines AS (SELECT w, len(w) AS n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS shown, count(DISTINCT doc_id) AS n_docs FROM t WHERE len(w) >= {short_tokens} OR len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]'))) > 0 GROUP BY w),
placed AS (SELECT *, least({depth}, (n + 1) // 2) AS lead, shown[1:least({depth}, (n + 1) // 2)] AS head, row_number() OVER () AS id FROM lines),
tokens AS (SELECT id, n, head, lead, n_docs, shown, unnest(shown) AS token, unnest(range(0, n)) AS place FROM placed),
leaves AS (SELECT n, head, sum(n_docs) AS leaf_docs FROM placed GROUP BY n, head),
often AS (SELECT n, head, place, token, true AS is_often FROM tokens JOIN leaves USING (n, head) WHERE token <> '<*>' GROUP BY n, head, place, token HAVING sum(n_docs) >= {min_docs} AND 100 * sum(n_docs) >= {constant_percent} * max(leaf_docs)),
marked AS (SELECT tokens.*, place < lead OR coalesce(is_often, false) AS fixed FROM tokens LEFT JOIN often USING (n, head, place, token)),
first AS (SELECT id, n, count(*) FILTER (token = '<*>' OR NOT fixed) AS fields FROM marked GROUP BY id, n),
others AS (SELECT id FROM first WHERE fields > 0 AND NOT (100 * fields <= {100 - percent} * n OR (fields = 1 AND n >= 3))),
near AS (SELECT id, n, head, place, token, n_docs, a, b, CASE WHEN place + a BETWEEN 0 AND n - 1 THEN shown[place + a + 1] ELSE '' END AS x, CASE WHEN place + b BETWEEN 0 AND n - 1 THEN shown[place + b + 1] ELSE '' END AS y
         FROM tokens SEMI JOIN others USING (id), (VALUES (-2, -1), (1, 2), (-1, 1), (-2, 2)) neighbours(a, b) WHERE place >= lead),
counts AS (SELECT n, head, place, a, b, x, y, token, sum(n_docs) AS c FROM near GROUP BY ALL),
shares AS (SELECT *, sum(c) OVER (PARTITION BY n, head, place, a, b, x, y) AS total FROM counts),
constants AS (SELECT n, head, place, a, b, x, y, token FROM shares WHERE token <> '<*>' AND c >= {min_docs} AND 100 * c >= {constant_percent} * total),
more AS (SELECT DISTINCT id, place, true AS is_more FROM near JOIN constants USING (n, head, place, a, b, x, y, token)),
shapes AS (SELECT id, list(CASE WHEN fixed OR is_more THEN token ELSE '<*>' END ORDER BY place) AS template FROM marked LEFT JOIN more USING (id, place) GROUP BY id),
general AS (SELECT w, n, template, len(list_filter(template, lambda x: x = '<*>')) AS fields FROM placed JOIN shapes USING (id)),
named AS (SELECT w, n, fields > 0 AND (100 * fields <= {100 - percent} * n OR (fields = 1 AND n >= 3)) AS is_general, CASE WHEN fields > 0 AND (100 * fields <= {100 - percent} * n OR (fields = 1 AND n >= 3)) THEN template ELSE w END AS name FROM general),
totals AS (SELECT is_general, name, min(doc_id) AS t_first FROM t JOIN named USING (w) GROUP BY ALL HAVING count(DISTINCT doc_id) >= CASE WHEN min(n) < {short_tokens} THEN {short_min_docs} ELSE {min_docs} END),
judged AS (SELECT doc_id, place, line, t_first IS NOT NULL AND t_first <> doc_id AS lost FROM t LEFT JOIN (SELECT w, t_first FROM named JOIN totals USING (is_general, name)) USING (w)),
clean AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '') AS text, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped FROM judged GROUP BY doc_id)
SELECT d.doc_id, clean.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped FROM documents d LEFT JOIN clean USING (doc_id)"""
