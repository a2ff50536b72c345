"""DuckDB SQL that gives what the queries give, by plainer ways."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH parsed AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), {_LOWER}), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parsed),
tokens AS (
  SELECT *, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
         list_sort(list_distinct(list_concat(
           list_transform(list_filter(regexp_split_to_array(host, '[.-]'), lambda w: w <> ''), lambda w: 'h:' || w),
           list_transform(list_filter(regexp_split_to_array(path, '[^A-Za-z0-9]+'), lambda w: w <> ''),
                          lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN 'n:' || w[1] ELSE 'p:' || w END),
           list_transform(regexp_extract_all(regexp_replace(coalesce(url, ''), '#.*', '', 's'), '[?&]([^=&]+)', 1), lambda w: 'q:' || w)))) AS items
  FROM judged),
labelled AS (SELECT page_id, row_number() OVER () AS r, items, given FROM tokens WHERE given IS NOT NULL),
size AS (SELECT count(*) AS n, count(*) FILTER (given = 'block') AS blocked FROM labelled),
token AS (
  SELECT t AS token, count(*) AS n, count(*) FILTER (given = 'block') AS blocked, list(r ORDER BY r) AS urls
  FROM (SELECT r, given, unnest(items) AS t FROM labelled) GROUP BY t HAVING count(*) >= 0.005 * (SELECT n FROM size)),
groups AS (
  SELECT row_number() OVER (ORDER BY abs(g.blocked * (size.n - size.blocked)::DOUBLE - (g.n - g.blocked) * size.blocked::DOUBLE) DESC, members) - 1 AS g, members
  FROM (SELECT urls, any_value(n) AS n, any_value(blocked) AS blocked, list(token ORDER BY token) AS members FROM token GROUP BY urls) g, size),
known AS (SELECT unnest(members) AS token, g FROM groups),
own AS (
  SELECT page_id, url, given, list_sort(list_distinct(list(g))) AS gs
  FROM (SELECT page_id, url, given, unnest(items) AS token FROM tokens) JOIN known USING (token) GROUP BY ALL),
transactions AS (SELECT r, l.given, o.gs[1:12] AS gs FROM labelled l JOIN own o USING (page_id)),
subsets AS (
  SELECT given, unnest(list_transform(range(1, (1 << len(gs))::BIGINT), lambda m: list_filter(gs, lambda x, i: (m >> (i - 1)) & 1 = 1))) AS ante FROM transactions),
counted AS (SELECT ante, count(*) AS n, count(*) FILTER (given = 'block') AS block, count(*) FILTER (given = 'allow') AS allow FROM subsets GROUP BY ante),
good AS (
  SELECT ante, v.verdict, v.k::DOUBLE / c.n AS confidence, v.k AS support
  FROM counted c, size, LATERAL (VALUES ('block', block, size.blocked), ('allow', allow, size.n - size.blocked)) v(verdict, k, every)
  WHERE v.k >= 0.005 * size.n AND v.k::DOUBLE / c.n >= 0.8 AND v.k::DOUBLE / c.n > v.every::DOUBLE / size.n),
rules AS (
  SELECT * FROM good x WHERE NOT EXISTS (
    SELECT 1 FROM good y WHERE y.verdict = x.verdict AND y.confidence >= x.confidence AND len(y.ante) = len(x.ante) - 1 AND list_has_all(x.ante, y.ante))),
fired AS (
  SELECT o.page_id, max(struct_pack(confidence := r.confidence, support := r.support, verdict := r.verdict)) AS best
  FROM own o JOIN rules r ON list_has_all(o.gs, r.ante) WHERE o.given IS NULL GROUP BY o.page_id)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.given, f.best.verdict, 'allow') AS verdict FROM tokens t LEFT JOIN fired f USING (page_id)
"""

_SPACE = r"\x20\x09-\x0D"
OP5 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM docs),
each AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
grams AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM each),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM grams JOIN twice USING (r, g), range(5) o(d) GROUP BY r),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs),
lines AS (
  SELECT r, line_no, line, regexp_extract_all(line, '[^{_SPACE}]+') AS w,
         row_number() OVER (PARTITION BY r, line ORDER BY line_no) > 1 AS later,
         len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, len(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper,
         len(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, contains(line, '!!') AS bangs
  FROM split WHERE regexp_matches(line, '[^{_SPACE}]')),
judged AS (
  SELECT r, line_no, len(w) AS n, later,
         later OR symbols > 0.3 * len(w) OR (bangs AND upper > 0.7 * greatest(1, letters))
         OR (len(w) <= 2 AND regexp_matches(w[-1][-1], '[\x00-\x7F]') AND NOT contains('.!?:;,)]"''', w[-1][-1]))
         OR (len(w) <= 40 AND regexp_matches(line, '^[{_SPACE}]*(?i:licensed under|copyright|all rights reserved|spdx-license-identifier|cookie|click here|sign in|log in|subscribe|privacy policy|terms of|share this|read more|back to top|lorem ipsum|javascript)')) AS fails
  FROM lines),
cleaned AS (SELECT split.r, string_agg(split.line, chr(10) ORDER BY split.line_no) FILTER (fails IS NULL OR NOT fails) AS left_text FROM split LEFT JOIN judged USING (r, line_no) GROUP BY split.r),
per AS (SELECT r, count(*) FILTER (later) AS dup, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words,
         md5(coalesce(left_text, '')) AS cleaned_md5
  FROM words LEFT JOIN covered USING (r) LEFT JOIN per USING (r) LEFT JOIN cleaned USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= 0.5 * n_words AS kept
FROM facts
"""

OP6 = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
sized AS (
  SELECT source, n, pow(n, 0.95) / sum(pow(n, 0.95)) OVER () * (m - s) AS share, m, s
  FROM counts, (SELECT count(*) AS s, (1024 * pow(2, greatest(0, ceil(log2(2.0 * count(*) / 1024)))))::BIGINT AS m FROM counts)),
quota AS (
  SELECT source, n, m, row_number() OVER (ORDER BY source) AS k,
         (1 + floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - round(share, 9), source) <= m - s - sum(floor(share)) OVER () THEN 1 ELSE 0 END)::BIGINT AS q
  FROM sized),
lists AS (SELECT list(q ORDER BY k) AS q, max(m) AS m FROM quota),
ran(t, done, k) AS (
  SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), NULL::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda c, i: c + CASE WHEN i = first THEN 1 ELSE 0 END), first
  FROM (SELECT t, done, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda i:
           CASE WHEN done[i] < q[i] AND done[i] * m // q[i] <= t + 1 THEN ((done[i] + 1) * m + q[i] - 1) // q[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS first
        FROM ran, lists WHERE t + 1 < m)),
plan AS (SELECT source, q, m, row_number() OVER (PARTITION BY ran.k ORDER BY t) - 1 AS j, t AS slot FROM ran JOIN quota ON ran.k = quota.k),
ends AS (SELECT min((n + 15) // 16 // quota.q * quota.m + slot) AS horizon FROM quota JOIN plan ON plan.source = quota.source AND plan.j = ((n + 15) // 16) % quota.q),
blocks AS (SELECT doc_id, coalesce(source, '') AS source, (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1) // 16 AS block FROM documents)
SELECT doc_id, b.source, block::BIGINT AS block, (block // q * m + slot)::BIGINT AS slot, block // q * m + slot < horizon AS in_mix
FROM blocks b JOIN plan p ON p.source = b.source AND p.j = block % p.q, ends
"""

OP7 = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^{_SPACE}]+') AS w FROM documents),
each AS (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM docs WHERE len(w) > 0),
sets AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS g FROM each),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(r, o) AS (SELECT r, r FROM docs UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM docs d LEFT JOIN sizes ON sizes.r = d.r JOIN reach ON reach.r = d.r JOIN docs o ON o.r = reach.o GROUP BY d.r, d.doc_id, n
"""

OP9 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
steps AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before, lead(role) OVER w IS NULL AS last FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + len(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + len(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')))::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AND (NOT last OR role = 'assistant')) AS valid
FROM steps GROUP BY conv_id
"""

ORACLE_SQL = {"op1_url_filters": OP1, "op5_quality_rules": OP5, "op6_mixing": OP6, "op7_minhash_near_dedup": OP7, "op9_chat_formatting": OP9}
