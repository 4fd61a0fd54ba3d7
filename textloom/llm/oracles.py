"""DuckDB SQL for what the corpus operators' queries return, where SQL can say it."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
windows AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counts AS (
 SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
 FROM d LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
s1 AS (SELECT source, source_size, 3 * source_size AS cap, CAST(1 + (nth - 1) % 3 AS DOUBLE) AS share FROM s),
s2 AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(share) OVER before, 0.0) AS share_before, row_number() OVER (ORDER BY cap / share, source NULLS LAST) AS place,
  sum(source_size) OVER () AS total, sum(share) OVER () AS shares
 FROM s1 WINDOW before AS (ORDER BY cap / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (shares - share_before) AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, place) FROM s3 WHERE level * share <= cap) AS free_level, (SELECT min(place) FROM s3 WHERE level * share <= cap) AS free_at FROM s3),
plan AS (SELECT source, source_size, least(CASE WHEN free_at IS NULL OR place < free_at THEN CAST(cap AS DOUBLE) ELSE free_level * share END, CAST(cap AS DOUBLE)) AS target FROM s4),
e AS (SELECT doc_id, d.source, size, source_size, target, least(3.0, coalesce(target / nullif(source_size, 0), 0.0)) AS expected,
  (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
 FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
f AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM e),
g AS (SELECT *, u / (1 - u) / (greatest(p, 1e-12) / (1 - least(p, 1 - 1e-12))) AS rank_key FROM f),
h AS (SELECT *, sum(CASE WHEN whole < 3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY source ORDER BY rank_key, doc_id NULLS FIRST, size) AS nth, target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM g),
k AS (SELECT *, whole < 3 AND upto <= rest AS first FROM h),
l AS (SELECT *, max(rest) OVER (PARTITION BY source) - coalesce(max(CASE WHEN first THEN upto END) OVER (PARTITION BY source), 0) AS left_over FROM k),
m AS (SELECT *, first_value(CASE WHEN NOT first AND whole < 3 AND p > 0 AND abs(left_over - size) < abs(left_over) THEN nth END) OVER
  (PARTITION BY source ORDER BY CASE WHEN NOT first AND whole < 3 AND p > 0 AND abs(left_over - size) < abs(left_over) THEN abs(left_over - size) END NULLS LAST, nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM l)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN first OR coalesce(nth = last, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TOKENS} AS w FROM benchmark),
items AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
windows AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT r, i, windows.k AS k, item FROM windows JOIN items USING (k, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INT) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), k, 1) AS INT)"
    f" ELSE CAST(substr('0246813579', CAST(substr(reverse({_DIGITS}), k, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _spans(k: int, kind: str) -> str:
    """Matches and the pieces between them take turns, so their lengths add up to places."""
    lists = f"SELECT r, string_split_regex(text, '{_BASE[kind]}') AS p, regexp_extract_all(text, '{_BASE[kind]}') AS m FROM d"
    rows = f"SELECT r, m[i] AS v, CAST(list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT r, p, m, unnest(range(1, len(m) + 1)) AS i FROM ({lists}))"
    return f"SELECT r, {k} AS k, '{kind}' AS kind, a, a + length(v) AS b FROM ({rows}) WHERE {_VALID[kind]}"


PII_BASE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, kind) for k, kind in enumerate(_BASE))}),
sums AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in _BASE)}, sha256(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)) AS base_sha256 FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in _BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256 FROM d LEFT JOIN sums USING (r)"""

_SAFE = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
_HEAD = "'<|im_start|>' || " + _SAFE.format("t.role") + " || chr(10)"
_BODY = _SAFE.format("t.text") + " || '<|im_end|>'"
_RENDER = f"coalesce(array_to_string(list_transform({{0}}, lambda t: {_HEAD} || {_BODY} || chr(10)), ''), '')"
_TRAINED = f"""coalesce(array_to_string(list_filter(list_transform({{0}}, lambda t, i: CASE WHEN t.role = 'assistant' THEN
 CAST(coalesce(list_sum({{1}}[1 : i - 1]), 0) + length({_HEAD}) AS VARCHAR) || ':' || CAST(coalesce(list_sum({{1}}[1 : i - 1]), 0) + length({_HEAD}) + length({_BODY}) AS VARCHAR) END), lambda x: x IS NOT NULL), ','), '')"""
_SIZES = f"list_transform({{0}}, lambda t: length({_HEAD}) + length({_BODY}) + 1)"

PREFERENCES = f"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
reply AS (SELECT conv_id, arg_max(text, {{'turn': turn, 'text': text}}) AS text, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
chosen AS (SELECT conv_id, turn, role, text FROM c WHERE conv_id IN (SELECT conv_id FROM reply)),
rejected AS (SELECT c.conv_id, turn, role, c.text FROM c JOIN reply USING (conv_id) WHERE turn < last UNION ALL SELECT r.conv_id, r.last, 'assistant', coalesce(o.text, '') FROM reply r LEFT JOIN reply o ON o.conv_id = r.conv_id + 1),
a AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS a FROM chosen GROUP BY conv_id),
b AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS b FROM rejected GROUP BY conv_id),
ab AS (SELECT conv_id, a, b, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i].role = b[i].role AND a[i].text = b[i].text, false)), false), 0) AS first FROM a JOIN b USING (conv_id)),
n AS (SELECT conv_id, a, b, CASE WHEN first > 0 THEN first - 1 ELSE greatest(len(a), len(b)) END AS common,
  coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i].role = 'assistant' THEN i END)), len(a) + 1) - 1 AS last FROM ab),
m AS (SELECT conv_id, a, b, CASE WHEN common = len(a) AND common = len(b) AND last < len(a) THEN last ELSE common END AS n FROM n),
q AS (SELECT conv_id, n, a[1 : n] AS p, a[n + 1 :] AS x, b[n + 1 :] AS y FROM m),
z AS (SELECT *, {_SIZES.format("x")} AS xs, {_SIZES.format("y")} AS ys FROM q)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_prefix, {_RENDER.format("p")} AS prompt, {_RENDER.format("x")} AS chosen, {_RENDER.format("y")} AS rejected, {_TRAINED.format("x", "xs")} AS chosen_spans, {_TRAINED.format("y", "ys")} AS rejected_spans FROM z"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
chunks AS (SELECT r, doc_id, n, base, substr(h, 2 * base + 1, 2098) AS c FROM (SELECT r, doc_id, n, h, unnest(range(0, n, 1000)) AS base FROM d)),
windows AS (SELECT r, doc_id, base + o AS p, substr(c, 2 * o + 1, 100) AS s FROM (SELECT r, doc_id, base, c, unnest(range(0, greatest(0, least(1000, n - 49 - base)))) AS o FROM chunks)),
least AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT r, p FROM windows JOIN least USING (s) WHERE first < doc_id),
marked AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone),
runs AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY r, k),
parts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM runs),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM parts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""

PREFIX_TRIE = """
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)),
turns AS (SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': d, 'b': b} ORDER BY turn NULLS FIRST, d, b) AS w FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 9 AS h FROM own, crc),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(g.w[1 : h.h], []), h.w[h.h + 1 :]) AS r FROM h LEFT JOIN own g ON g.conv_id = h.conv_id - h.conv_id % 5),
members AS (SELECT conv_id, d, array_to_string(list_transform(r[1 : d], lambda x: x.d), '') AS k, CASE WHEN d > 0 THEN r[d].b ELSE 0 END AS b, d = len(r) AS ends FROM (SELECT conv_id, r, unnest(range(0, len(r) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n, coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends FROM members GROUP BY k, d),
children AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
below AS (SELECT left(k, 32 * j) AS k, sum((n - 1) * b) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM whole) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below USING (k) LEFT JOIN nodes p ON w.d > 0 AND p.k = left(w.k, 32 * (w.d - 1))"""

ORACLE_SQL = {
    "op11_conversation_prefix_trie": PREFIX_TRIE,
    "op6_pareto_mixing": MIXING,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op9_preference_formatting": PREFERENCES,
    "op10_suffix_array_dedup": SUBSTRINGS,
    "quality_base_counts": QUALITY,
    "pii_base_spans": PII_BASE,
}
