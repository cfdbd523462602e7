"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tarnflow.llm.substring_dedup import BASE, BLANKS, ENDS, LEAST_WORDS, SOLO, SPAN, WINDOW

ORACLE_SQL: dict[str, str] = {}

#: A-Z in lower case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components: the smallest node that links (a, b), given both ways, can reach.
_REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""


def _class(chars: str, *ranges: tuple[int, int]) -> str:
    """Characters and ranges as they stand in a bracket of a regular expression."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _substring_dedup() -> str:
    blank, end, solo = _class(BLANKS), _class(ENDS.replace("\n", "")), _class("", *SOLO)
    word = f"(?:[{solo}]|[^{blank}{solo}{end}]+)[{end}]*|[{end}]+"
    ends, w = f"[{_class(ENDS)}]", WINDOW - 1
    return f"""
WITH docs AS (SELECT doc_id, text, regexp_extract(text, '^[{blank}]*') AS lead FROM documents),
cut AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:{word})[{blank}]*') AS pieces FROM docs)),
words AS (SELECT doc_id, i, piece, regexp_extract(piece, '^[^{blank}]*') AS word, regexp_matches(piece, '{ends}') OR i = max(i) OVER (PARTITION BY doc_id) AS ends FROM cut),
hashes AS (SELECT word, list_reduce(list_concat([{BASE}::HUGEINT], list_transform(string_split(word, ''), lambda c: unicode(c)::HUGEINT), [0::HUGEINT]), lambda h, c: (h * {BASE}::HUGEINT + c) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT word FROM words)),
placed AS (SELECT words.*, h, sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(ends AS INT) AS sentence FROM words JOIN hashes USING (word)),
windows AS (SELECT *, CASE WHEN count(*) OVER n = {WINDOW} THEN min(h) OVER n END AS low FROM placed WINDOW n AS (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING)),
marks AS (SELECT *, ends OR coalesce(max(low) OVER (PARTITION BY doc_id, sentence ORDER BY i ROWS BETWEEN {w} PRECEDING AND CURRENT ROW) = h, false) AS cuts FROM windows),
parted AS (SELECT *, sum(CAST(cuts AS INT)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(cuts AS INT) AS p FROM marks),
parts AS (SELECT doc_id, CAST(p AS INT) AS p, min(i) AS lo, max(i) + 1 AS hi, string_agg(piece, '' ORDER BY i) AS piece FROM parted GROUP BY ALL),
texts AS (SELECT doc_id, list(word ORDER BY i) AS ws FROM words GROUP BY doc_id),
runs AS (SELECT a.doc_id, a.p AS a, b.p AS b, a.lo, b.hi FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p + {SPAN - 1} AND a.p + {max(SPAN, LEAST_WORDS) - 1} AND b.hi - a.lo >= {LEAST_WORDS}),
shortest AS (SELECT doc_id, a, min(b) AS b, lo, min(hi) AS hi FROM runs GROUP BY doc_id, a, lo UNION SELECT doc_id, max(a), b, max(lo), hi FROM runs GROUP BY doc_id, b, hi),
spans AS (SELECT doc_id, a, b, md5(array_to_string(list_slice(ws, lo + 1, hi), chr(1))) AS k FROM shortest JOIN texts USING (doc_id)),
again AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS place FROM spans),
gone AS (SELECT DISTINCT doc_id, CAST(p AS INT) AS p FROM (SELECT doc_id, unnest(range(a, b + 1)) AS p FROM again WHERE place > 1)),
kept AS (SELECT parts.doc_id, count(*) AS n, count(gone.p) AS removed, string_agg(CAST(gone.p AS VARCHAR), ',' ORDER BY gone.p) AS which, string_agg(CASE WHEN gone.p IS NULL THEN (CASE WHEN parts.p = 0 THEN lead ELSE '' END) || parts.piece END, '' ORDER BY parts.p) AS rest FROM parts JOIN docs USING (doc_id) LEFT JOIN gone ON gone.doc_id = parts.doc_id AND gone.p = parts.p GROUP BY parts.doc_id)
SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN coalesce(n, 1) ELSE 0 END AS INT) AS n_sentences, CAST(coalesce(removed, 0) AS INT) AS n_removed, coalesce(which, '') AS removed, CASE WHEN text IS NULL THEN NULL WHEN coalesce(removed, 0) = 0 THEN text ELSE coalesce(rest, '') END AS kept_text
FROM docs LEFT JOIN kept USING (doc_id)"""


ORACLE_SQL["op1_substring_dedup"] = _substring_dedup()

ORACLE_SQL["op5_fuse_filter_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

ORACLE_SQL["op7_url_filter"] = f"""
WITH cut AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM cut JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id),
listed AS (SELECT site || '.' || domain || '/' || lang || '/' || id AS key FROM (SELECT unnest(['spam-farm', 'cheap-pills', 'adult-x']) AS site), (SELECT unnest(['example.com', 'example.net']) AS domain), (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang), range(1000) r(id) WHERE id % 3 <> 0)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, key IS NOT NULL AS listed
FROM cut LEFT JOIN best USING (page_id) LEFT JOIN listed ON key = regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '')"""

ORACLE_SQL["op8_ngram_jaccard"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
{_REACH}
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(l.b, t.doc_id)) AS component_id FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN least l ON l.a = t.doc_id"""

ORACLE_SQL["op10_pq_near_vectors"] = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM vectors WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) >= 0.95 * x.n * y.n),
{_REACH}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id"""

ORACLE_SQL["op11_fill_in_middle"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS d FROM documents),
drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM texts),
cuts AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""

ORACLE_SQL["op12_filter_audit"] = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM texts),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN flags USING (doc_id) GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, step, instr('ABCDE', substr(o, step, 1)) AS f, list_transform(range(1, step), lambda i: instr('ABCDE', substr(o, i, 1))) AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) WHERE length(o) = 5),
met AS (SELECT c.*, s.*, fails[f] AS fail, len(list_filter(before, lambda i: coalesce(fails[i], false))) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM cells c CROSS JOIN steps s),
sums AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fail AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fail AND alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums"""
