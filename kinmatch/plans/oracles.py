"""DuckDB SQL that gives what the queries over the driver's tables give, by plainer ways.

Names of the listings have two words, or are one of a few fixed ones, so that the likeness of tokens
has a closed form here. With three sources a conflict of clusters can only arise at a pair of the
second and third, so clusters have a closed form too; assignment is a recursion.
"""

from __future__ import annotations

_LETTERS = "'0123456789abcdef', 'bcdfgklmnprstvae'"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(strip_accents(lower({x})), 'ı', 'i'), '&', ''), '[^a-z0-9]+', ' ', 'g'))"


def _name(seed: str, value: str) -> str:
    digest = f"translate(md5('{seed}' || ({value})::VARCHAR), {_LETTERS})"
    word = lambda a, n: f"upper(substr({digest}, {a}, 1)) || substr({digest}, {a + 1}, {n - 1})"
    return f"({word(1, 6)} || ' ' || {word(7, 7)})"


_LISTINGS = f"""
base AS (
  SELECT event_id AS k, ts, event_type, site_idx, event_id % 37 = 5 AND site_idx = 2 AS swapped,
         CASE WHEN event_id % 997 = 0 THEN 'Sporting United' WHEN event_id % 43 = 0 THEN ['Man Utd U21', 'Manchester United U21', 'Man United U21'][site_idx + 1] ELSE {_name("h", "user_id")} END AS h,
         CASE WHEN event_id % 997 = 0 THEN 'Real City' ELSE {_name("a", "event_id % 997")} END AS a
  FROM events, (VALUES (0), (1), (2)) s(site_idx) WHERE (event_id + site_idx) % 11 <> 0 AND (site_idx = 0 OR event_id % 29 <> 3)),
moved AS (
  SELECT k, event_type, site_idx, swapped,
         CASE WHEN site_idx = 1 AND k % 3 = 0 THEN h || ' FC' WHEN site_idx = 2 AND k % 4 = 0 THEN upper(h) ELSE h END AS h, CASE WHEN site_idx = 2 AND k % 3 = 1 THEN 'AS ' || a ELSE a END AS a,
         ts + to_minutes(CASE WHEN site_idx = 2 AND k % 5 = 0 THEN 30 WHEN site_idx = 1 AND k % 41 = 7 THEN 1440 WHEN site_idx = 1 AND k % 13 = 0 THEN -15 ELSE 0 END) AS t FROM base),
listings AS (
  SELECT ['alpha', 'beta', 'gamma'][site_idx + 1] AS site, site_idx, k AS row_id, (site_idx::BIGINT << 48) + k AS rid, ['FUTBOL', 'BASKETBOL', 'VOLEYBOL', 'TENIS', 'HENTBOL'][k % 5 + 1] AS sport,
         CASE WHEN site_idx = 1 THEN 'League ' ELSE '' END || event_type AS league, event_type AS league_core, ['England', 'Spain', 'Italy'][k % 3 + 1] AS country,
         ['England', 'Spain', 'Italy'][k % 3 + 1] || ' - ' || CASE WHEN site_idx = 1 THEN 'League ' ELSE '' END || event_type AS league_raw, 'e' || k AS event_id,
         strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H:%M') AS time, epoch_ms(date_trunc('minute', t)) - 180 * 60000 AS epoch_ms,
         CASE WHEN swapped THEN a ELSE h END AS home, CASE WHEN swapped THEN h ELSE a END AS away
  FROM moved)"""
_NORM = "trim(regexp_replace(regexp_replace({0}, ' fc$', ''), '^as ', ''))"

_WEAK = "('sporting', 'united', 'utd', 'real', 'city', 'as')"
_PAIRS = "names AS (SELECT DISTINCT lower(p_name) AS a FROM part), pairs AS (SELECT x.a, y.a AS b FROM names x, names y)"
_RATIO = "100 * greatest(0, 1 - levenshtein({0}, {1})::DOUBLE / greatest(len({0}), len({1})))"
_SORT = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"



def _similarity(a: str, b: str, parts: bool = True) -> str:
    """Likeness of two names; with parts, of names of two words each."""
    x, y = (f"string_split({n}, ' ')" for n in (a, b))
    near = lambda u, v: f"(len({u}) <> len({v}) AND (starts_with({u}, {v}) OR starts_with({v}, {u})))"
    x1, x2, y1, y2 = f"{x}[1]", f"{x}[2]", f"{y}[1]", f"{y}[2]"
    weight = lambda t: f"list_sum(list_transform({t}, lambda w: CASE WHEN w IN {_WEAK} THEN 0.5 ELSE 1.0 END))"
    at = f"CASE WHEN {x1} = {y1} THEN 1 WHEN {x1} = {y2} THEN 2 WHEN {near(x1, y1)} THEN 1 WHEN {near(x1, y2)} THEN 2 ELSE 0 END"
    second = f"(({at}) <> 1 AND ({x2} = {y1} OR {near(x2, y1)})) OR (({at}) <> 2 AND ({x2} = {y2} OR {near(x2, y2)}))"
    overlap = f"least(100, 100.0 * (CASE WHEN ({at}) > 0 THEN 1 ELSE 0 END + CASE WHEN {second} THEN 1 ELSE 0 END) / greatest({weight(x)}, {weight(y)}))"
    if not parts:
        overlap = f"CASE WHEN {near(a, b)} THEN 100 ELSE 0 END"
    chars, ordered = _RATIO.format(a, b), _RATIO.format(_SORT.format(a), _SORT.format(b))
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100 ELSE greatest({chars}, {ordered}, {overlap}) END)"


def _team(x: str, y: str) -> str:
    """struct of score and stage of two names' features."""
    result = lambda score, stage: f"struct_pack(score := ({score})::DOUBLE, stage := '{stage}')"
    return f"""CASE WHEN {x}.quals <> {y}.quals THEN {result(0, "rejected")} WHEN {x}.norm = {y}.norm THEN {result(100, "exact")} WHEN {x}.id = {y}.id THEN {result(100, "alias")}
      WHEN len({x}.strong) = 0 AND len({y}.strong) = 0 THEN {result(0, "rejected")} ELSE {result(_similarity(f"{x}.norm", f"{y}.norm"), "fuzzy")} END"""


def _features(name: str) -> str:
    norm = _NORM.format(f"lower({name})")
    return f"""struct_pack(norm := {norm}, quals := CASE WHEN contains({norm}, ' u21') THEN 'u21' ELSE '' END,
      id := CASE WHEN {norm} IN ('man utd u21', 'manchester united u21', 'man united u21') THEN 'manchester_united' END,
      strong := list_filter(string_split({norm}, ' '), lambda w: w NOT IN {_WEAK}))"""


_FEATURES = f"""{_LISTINGS},
featured AS (SELECT *, {_features("home")} AS h, {_features("away")} AS a FROM listings),
sig AS (
  SELECT site_idx, rid, sport, date, list_filter(keys, lambda k, i: list_position(keys, k) = i) AS keys
  FROM (SELECT *, list_transform(list_concat(h.strong, a.strong), lambda t: t[1:3]) AS keys FROM featured))"""
_CANDIDATES = f"""{_FEATURES},
probed AS (SELECT site_idx, rid, sport, date, list_append(keys, '') AS keys FROM sig),
probe AS (SELECT site_idx, rid, sport, o AS day_offset, strftime(date::DATE + o::INT, '%Y-%m-%d') AS day, unnest(keys) AS key, generate_subscripts(keys, 1) - 1 AS pos FROM probed, (VALUES (-1), (0), (1)) d(o)),
target AS (SELECT site_idx, rid, sport, date AS day, unnest(CASE WHEN len(keys) = 0 THEN [''] ELSE keys END) AS key FROM sig),
candidates AS (
  SELECT p.rid AS a, t.rid AS b, min(struct_pack(o := day_offset, p := pos)) AS f
  FROM probe p JOIN target t ON p.sport = t.sport AND p.day = t.day AND p.key = t.key AND p.site_idx < t.site_idx GROUP BY ALL)"""
_SCORED = f"""{_CANDIDATES},
sides AS (
  SELECT c.a, c.b, c.f.o AS day_offset, c.f.p AS prefix_pos, x.site_idx AS site_a, y.site_idx AS site_b, x.sport, x.date <> y.date AS cross_date,
         floor((y.epoch_ms - x.epoch_ms) / 60000 + 0.5)::BIGINT AS diff, x.country = y.country AS same_country, x.league_core AS xl, y.league_core AS yl,
         (x.h.quals || x.a.quals) <> (y.h.quals || y.a.quals) AND x.sport <> 'TENIS' AS other_class, x.h AS xh, x.a AS xa, y.h AS yh, y.a AS ya
  FROM candidates c JOIN featured x ON c.a = x.rid JOIN featured y ON c.b = y.rid),
early AS (
  SELECT *, CASE WHEN other_class THEN 'league-qualifier-mismatch' WHEN NOT same_country THEN 'different-country' WHEN cross_date AND abs(diff) > 2160 THEN 'implausible-time-gap' END AS early,
         CASE WHEN other_class OR NOT same_country THEN 0 ELSE {_similarity("xl", "yl", parts=False)} END AS league FROM sides),
straight AS (SELECT *, {_team("xh", "yh")} AS hh, {_team("xa", "ya")} AS aa, {_team("xh", "ya")} AS ha, {_team("xa", "yh")} AS ah FROM early),
flips AS (
  SELECT *, hh.score >= 78 AND aa.score >= 78 AS ok, ha.score >= 78 AND ah.score >= 78 AS cross_ok, (hh.score + aa.score) / 2 AS plain, (ha.score + ah.score) / 2 AS crossed FROM straight),
turned AS (SELECT *, early IS NULL AND NOT ok AND (cross_ok OR crossed > plain) AS flipped FROM flips),
teams AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN 0 WHEN flipped THEN crossed ELSE plain END AS team, CASE WHEN flipped THEN cross_ok ELSE ok END AS fine,
         CASE WHEN flipped THEN ha.stage <> 'fuzzy' AND ah.stage <> 'fuzzy' ELSE hh.stage <> 'fuzzy' AND aa.stage <> 'fuzzy' END AS sure FROM turned),
judged AS (SELECT *, coalesce(early, CASE WHEN NOT fine THEN 'team-below-threshold' WHEN league < 35 AND team < 88 THEN 'low-league-weak-team' END) AS reason FROM teams),
c1 AS (SELECT *, CASE WHEN sure THEN least(1.0::DOUBLE, team / 100 + 0.03::DOUBLE) ELSE team / 100 END AS c FROM judged),
c2 AS (SELECT * REPLACE (CASE WHEN xl = yl THEN least(1.0::DOUBLE, c + 0.05::DOUBLE) WHEN league < 35 THEN c - 0.08::DOUBLE ELSE c END AS c) FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN abs(diff) <= 5 THEN least(1.0::DOUBLE, c + 0.04::DOUBLE) WHEN abs(diff) > 180 THEN c - 0.05::DOUBLE ELSE c END AS c) FROM c2),
scored AS (
  SELECT a, b, day_offset, prefix_pos, site_a, site_b, team AS team_score, CASE WHEN early IS NULL THEN league ELSE 0 END AS league_score, flipped, reason, diff, cross_date,
         CASE WHEN reason IS NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) ELSE 0 END AS confidence,
         team * 1000 + league - CASE WHEN cross_date THEN 500 ELSE 0 END - least(abs(diff), 999) / 1000.0::DOUBLE AS rank FROM c3),
decided AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'no_match' WHEN confidence >= 0.92 THEN 'match' WHEN confidence >= 0.75 THEN 'possible_match' ELSE 'no_match' END AS decision FROM scored)"""
_MATCHED = f"""{_SCORED},
edges AS MATERIALIZED (SELECT * EXCLUDE (reason) FROM decided WHERE reason IS NULL AND confidence >= 0.75),
steps AS (
  SELECT *, false AS won FROM edges
  UNION ALL
  SELECT * EXCLUDE (best, a_used, b_used) REPLACE (best AS won)
  FROM (SELECT *, bool_or(best) OVER (PARTITION BY site_a, site_b, a) AS a_used, bool_or(best) OVER (PARTITION BY site_a, site_b, b) AS b_used
        FROM (SELECT *, row_number() OVER (PARTITION BY site_a, site_b, a ORDER BY rank DESC, a, day_offset, prefix_pos, b) = 1 AND row_number() OVER (PARTITION BY site_a, site_b, b ORDER BY rank DESC, a, day_offset, prefix_pos, b) = 1 AS best
              FROM steps WHERE NOT won))
  WHERE best OR NOT (a_used OR b_used)),
matched AS MATERIALIZED (SELECT * FROM steps WHERE won)"""
_CLUSTERED = f"""{_MATCHED},
p01 AS (SELECT a, b FROM matched WHERE site_a = 0 AND site_b = 1), p02 AS (SELECT a, b FROM matched WHERE site_a = 0 AND site_b = 2), p12 AS (SELECT a, b FROM matched WHERE site_a = 1),
joined AS (
  SELECT p.a, p.b, l.a AS first_of_a, r.a AS first_of_b, lr.b AS third_of_a, rl.b AS second_of_b
  FROM p12 p LEFT JOIN p01 l ON l.b = p.a LEFT JOIN p02 r ON r.b = p.b LEFT JOIN p02 lr ON lr.a = l.a LEFT JOIN p01 rl ON rl.a = r.a),
links AS (SELECT a, b FROM joined WHERE CASE WHEN first_of_a IS NOT NULL AND first_of_b IS NOT NULL THEN first_of_a = first_of_b WHEN first_of_a IS NOT NULL THEN third_of_a IS NULL WHEN first_of_b IS NOT NULL THEN second_of_b IS NULL ELSE true END),
seconds AS (SELECT l.rid, coalesce(p.a, q.a, l.rid) AS cluster_id FROM listings l LEFT JOIN p01 p ON p.b = l.rid LEFT JOIN links k ON k.a = l.rid LEFT JOIN p02 q ON q.b = k.b WHERE l.site_idx = 1),
thirds AS (SELECT l.rid, coalesce(p.a, s.cluster_id, l.rid) AS cluster_id FROM listings l LEFT JOIN p02 p ON p.b = l.rid LEFT JOIN links k ON k.b = l.rid LEFT JOIN seconds s ON s.rid = k.a WHERE l.site_idx = 2),
clusters AS MATERIALIZED (SELECT rid, rid AS cluster_id FROM listings WHERE site_idx = 0 UNION ALL FROM seconds UNION ALL FROM thirds)"""
_ANALYSED = f"""{_CLUSTERED},
members AS (SELECT l.*, cluster_id, count(*) OVER (PARTITION BY cluster_id, epoch_ms) AS agree FROM listings l JOIN clusters USING (rid)),
analysed AS MATERIALIZED (
  SELECT cluster_id, count(*) AS n, (max(epoch_ms) - min(epoch_ms)) // 60000 AS gap, first(epoch_ms ORDER BY agree DESC, epoch_ms) AS reference, arg_min(struct_pack(site, sport, league, league_raw, date, time, home, away, event_id), site_idx) AS f FROM members GROUP BY cluster_id)"""
_COLLECTED = """
fetched AS (
  SELECT event_id AS arrival, event_type AS sport, CASE WHEN event_id % 17 = 0 THEN '' ELSE (event_id % 700)::VARCHAR END AS event_id, (event_id % 9)::VARCHAR AS league_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'L' || event_id % 4 END AS league_name, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Land' END AS country_name,
         strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, 'u' || user_id AS home, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'rest' END AS away
  FROM events),
judged AS (SELECT *, CASE WHEN away = '' THEN 'skipped' WHEN date NOT BETWEEN '2024-01-03' AND '2024-01-20' THEN 'filtered' ELSE 'added' END AS first_state,
                  CASE WHEN country_name = '' THEN coalesce(league_name, 'LIG_' || league_id) ELSE country_name || ' - ' || coalesce(league_name, 'LIG_' || league_id) END AS league_key FROM fetched),
collected AS (
  SELECT *, CASE WHEN first_state = 'added' AND event_id <> '' AND row_number() OVER (PARTITION BY sport, event_id, first_state ORDER BY arrival) > 1 THEN 'duplicate' ELSE first_state END AS state FROM judged)"""

ORACLE_SQL = {
    "text_fold": f"""
SELECT DISTINCT name, {_fold("name")} AS folded, trim(regexp_replace(strip_accents(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS label
FROM (SELECT '  É. ' || p_name || ' & Co.-' || p_type AS name FROM part UNION ALL SELECT c_name || '''s İŞ' FROM customer)""",
    "text_fold_documents": f"SELECT doc_id, md5({_fold('text')}) AS folded_md5 FROM documents",
    "text_tokens": """
WITH f AS (SELECT p_partkey, trim(regexp_replace(lower('fc ' || p_name || ' fc prag ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS m,
                  trim(regexp_replace(lower('f c ' || p_name || ' fc prag ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS raw FROM part)
SELECT p_partkey, m AS merged, array_to_string(list_filter(string_split(m, ' '), lambda t: t <> 'fc'), ' ') AS stripped,
       array_to_string(list_transform(string_split(m, ' '), lambda t: CASE WHEN t = 'prag' THEN 'prague' ELSE t END), ' ') AS exonyms,
       array_to_string(list_sort(string_split(raw, ' ')), ' ') AS sorted
FROM f""",
    "text_season": "SELECT p_partkey, lower(p_name) || CASE WHEN p_size >= 0 THEN ' ' || p_size ELSE '' END AS league_name FROM part",
    "team_qualifiers": """
SELECT p_partkey, lower(p_name) AS core, ['', 'u21', 'women', 'b', 'reserve', 'reserve,women'][p_partkey % 6 + 1] AS quals,
       ['academy', 'academy,u21', 'academy,women', 'academy', 'academy,reserve', 'academy,reserve,women'][p_partkey % 6 + 1] AS match_quals FROM part""",
    "team_names": f"""
WITH {_LISTINGS} SELECT DISTINCT name, sport, {_NORM.format("lower(name)")} AS normalized FROM (SELECT home AS name, sport FROM listings UNION ALL SELECT away, sport FROM listings)""",
    "team_resolution": "SELECT c_custkey, ['manchester_united', 'paris_saint_germain', 'borussia_dortmund', NULL, 'deportivo_la_guaira', 'nation_netherlands'][c_custkey % 6 + 1] AS team_id FROM customer",
    "league_resolution": """
SELECT c_custkey, r.* FROM customer JOIN (VALUES
  (0, 'EPL', 'England', false, true, 'epl', '', 'england_premier_league', true), (1, 'Super Lig', 'Turkiye', false, true, 'super lig', '', 'turkiye_super_lig', true),
  (2, 'UEFA Champions League - League Stage', NULL, true, false, 'uefa champions', '', 'uefa_champions_league', true), (3, 'Serie A', 'Brazil', false, true, 'serie a', '', 'brazil_serie_a', true),
  (4, 'Serie A, Women', 'NATION', false, false, 'serie a', 'women', NULL, false), (5, 'Bundesliga', NULL, false, false, 'bundesliga', '', 'germany_bundesliga', false)
) r(k, name, country, is_region, country_known, core, quals, canonical_id, canonical_confident) ON c_custkey % 6 = k""".replace("SELECT c_custkey, r.*", "SELECT c_custkey, r.name, r.country, r.is_region, r.country_known, r.core, r.quals, r.canonical_id, r.canonical_confident"),
    "sport_catalog": """
SELECT label, count(*) AS n, sport, coalesce(sport, upper(label)) AS canonical, rank FROM events JOIN (VALUES
  (0, 'Football', 'FUTBOL', 0), (1, 'IceHockey', 'BUZ_HOKEYI', 5), (2, 'RugbyUnion', 'RAGBI', 9), (3, 'Formula1', 'FORMULA_1', 13), (4, 'chess', 'SATRANC', 20), (5, 'Quidditch', NULL, 34)
) c(k, label, sport, rank) ON event_id % 6 = k GROUP BY ALL""",
    "similarity_chars": f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b)::BIGINT AS distance, round({_RATIO.format('a', 'b')}, 6) AS ratio, round({_RATIO.format(_SORT.format('a'), _SORT.format('b'))}, 6) AS sorted_ratio FROM pairs",
    "similarity_tokens": f"""
WITH {_PAIRS}, s AS (SELECT a, b, string_split(a, ' ') AS x, [b[1], string_split(b, ' ')[-1]] AS y FROM pairs)
SELECT a, b, round(100.0 * least(2, CASE WHEN x[1] = y[2] THEN 1 + (CASE WHEN starts_with(x[2], y[1]) THEN 1 ELSE 0 END)
             ELSE (CASE WHEN starts_with(x[1], y[1]) OR starts_with(x[1], y[2]) OR starts_with(y[2], x[1]) THEN 1 ELSE 0 END)
                + (CASE WHEN x[2] = y[2] THEN 1 WHEN starts_with(x[2], y[1]) AND NOT starts_with(x[1], y[1]) THEN 1
                        WHEN starts_with(x[2], y[2]) OR starts_with(y[2], x[2]) THEN 1 ELSE 0 END) END) / 2, 6) AS overlap,
       CASE WHEN substr(x[1], 1, 1) || substr(x[2], 1, 1) = substr(b, 1, 1) || substr(string_split(b, ' ')[2], 1, 1) THEN 100.0 ELSE 0.0 END AS acronym FROM s""",
    "time_epochs": """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE epoch_ms(date_trunc('minute', ts)) - 10800000 END AS epoch_ms, epoch_ms(date_trunc('day', ts)) AS date_ms,
       strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before FROM events""",
    "time_rollover": "SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate) + INTERVAL 30 DAY) AS date_ms FROM orders",
    "time_compare": """
WITH t AS (SELECT event_id, date_trunc('minute', ts) AS a, date_trunc('minute', ts + to_minutes((event_id % 4000)::INT)) AS b FROM events),
d AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN (epoch_ms(b) - epoch_ms(a)) // 60000 END AS diff_minutes, a::DATE = b::DATE AS same FROM t)
SELECT event_id, diff_minutes, diff_minutes IS NOT NULL AS comparable, coalesce(diff_minutes > 5, false) AS is_different, diff_minutes IS NULL OR same OR diff_minutes <= 2160 AS plausible FROM d""",
    "time_local": """
SELECT event_id, CASE WHEN event_id % 10 > 0 THEN strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') ELSE 'UNKNOWN_DATE' END AS local_date, CASE WHEN event_id % 10 > 0 THEN strftime(ts + INTERVAL 3 HOUR, '%H:%M') ELSE '' END AS local_time,
       strftime(ts, '%Y-%m-%d') AS written_date, strftime(ts, '%H:%M') AS written_time FROM events""",
    "collect_states": f"WITH {_COLLECTED} SELECT arrival, state, league_key FROM collected",
    "collect_counters": f"WITH {_COLLECTED} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'duplicate') AS duplicate, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'filtered') AS filtered FROM collected",
    "collect_summary": f"WITH {_COLLECTED} SELECT sport, count(DISTINCT league_key) AS leagues, count(*) AS matches FROM collected WHERE state = 'added' GROUP BY sport",
    "nested_round_trip": f"""
WITH {_COLLECTED} SELECT sport, league_key AS league, date, (row_number() OVER (PARTITION BY sport, league_key, date ORDER BY time, home || '-' || away, event_id, league_id) - 1)::INT AS at, event_id, home, time
FROM collected WHERE state = 'added'""",
    "json_scan": """
SELECT strftime(ts, '%Y-%m-%d') || '_' || event_type AS site, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY event_id) - 1 AS row_id, 'FUTBOL' AS sport, event_type AS league, strftime(ts, '%Y-%m-%d') AS date,
       strftime(ts, '%H:%M') AS time, epoch_ms(date_trunc('minute', ts)) - 10800000 AS epoch_ms, 'u' || user_id AS home, event_id::VARCHAR AS event_id FROM events""",
    "upsert_rows": """
WITH changes AS (SELECT s_suppkey * 2 AS s_suppkey, 'new ' || s_name AS s_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM changes) UNION ALL SELECT * FROM changes""",
    "replace_sites": """
WITH fresh AS (SELECT c_mktsegment AS site, c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_custkey % 2 = 0)
SELECT c_mktsegment AS site, c_custkey FROM customer WHERE c_mktsegment NOT IN (SELECT site FROM fresh) UNION ALL SELECT * FROM fresh""",
    "similarity_ratio": f"WITH {_PAIRS} SELECT * FROM (SELECT a, b, round({_similarity('a', 'b')}::DOUBLE, 6) AS score FROM pairs) WHERE score >= 60",
    "blocking_pairs": f"WITH {_CANDIDATES} SELECT a, b, f.o::INT AS day_offset, f.p::INT AS prefix_pos FROM candidates",
    "scored_pairs": f"WITH {_SCORED} SELECT a, b, round(team_score::DOUBLE, 6) AS team_score, round(league_score::DOUBLE, 6) AS league_score, flipped, round(confidence::DOUBLE, 6) AS confidence, decision, reason FROM decided",
    "matched_pairs": f"""
WITH RECURSIVE {_MATCHED} SELECT a, b, site_a, site_b, floor(team_score * 10 + 0.5) / 10 AS team_score, floor(league_score * 10 + 0.5) / 10 AS league_score, floor(confidence * 1000 + 0.5) / 1000 AS confidence,
  decision, flipped, diff AS diff_minutes, cross_date, abs(diff) > 0 AS is_different FROM matched""",
    "unmatched_rows": f"""
WITH RECURSIVE {_MATCHED}, ends AS (SELECT a AS rid, site_b AS other FROM matched UNION SELECT b, site_a FROM matched)
SELECT site, ['alpha', 'beta', 'gamma'][o + 1] AS other, row_id, home, away FROM listings l, (VALUES (0), (1), (2)) s(o)
WHERE o <> site_idx AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.rid = l.rid AND e.other = o)""",
    "clusters": f"WITH RECURSIVE {_CLUSTERED} SELECT rid, cluster_id FROM clusters",
    "report_discrepancies": f"""
WITH RECURSIVE {_ANALYSED},
text AS (
  SELECT cluster_id, string_agg(site || '=' || time, ';' ORDER BY site) AS times, string_agg(site || '=' || date, ';' ORDER BY site) AS dates, count(DISTINCT date) > 1 AS date_differs,
         coalesce(string_agg('{{"site":"' || site || '","minutes":' || ((epoch_ms - reference) // 60000) || '}}', ',' ORDER BY site) FILTER (epoch_ms <> reference), '') AS off,
         list(site) AS present, string_agg(site || '=' || league_raw, ';' ORDER BY site) AS leagues, string_agg(site || '=' || home || ' - ' || away, ';' ORDER BY site) AS teams
  FROM members JOIN analysed USING (cluster_id) GROUP BY cluster_id)
SELECT f.sport, f.league, f.date, f.home, f.away, times, dates, date_differs, gap AS max_diff_minutes, '[' || off || ']' AS deviating,
       array_to_string(list_filter(['alpha', 'beta', 'gamma'], lambda s: NOT list_contains(present, s)), ',') AS missing, leagues, teams
FROM analysed JOIN text USING (cluster_id) WHERE n > 1 AND gap > 0""",
    "report_summary": f"WITH RECURSIVE {_ANALYSED} SELECT count(*) AS groups, count(*) FILTER (n > 1) AS comparable, count(*) FILTER (n > 1 AND gap > 0) AS different, count(*) FILTER (n > 1 AND gap = 0) AS same FROM analysed",
    "report_coverage": f"WITH RECURSIVE {_ANALYSED} SELECT n::INT AS n_sites, count(*) AS clusters FROM analysed GROUP BY n",
    "report_sites": f"WITH RECURSIVE {_ANALYSED} SELECT site, count(*) AS total, count(*) FILTER (n = 1) AS only_here FROM members JOIN analysed USING (cluster_id) GROUP BY site",
    "report_pair_counts": f"WITH RECURSIVE {_MATCHED} SELECT site_a, site_b, count(*) AS matches FROM matched GROUP BY site_a, site_b",
    "report_single_site": f"WITH RECURSIVE {_ANALYSED} SELECT f.site, f.sport, f.league_raw AS league, f.date, f.time, f.home, f.away, f.event_id FROM analysed WHERE n = 1",
    "cluster_times": f"""
WITH {_LISTINGS},
counted AS (SELECT *, count(*) OVER (PARTITION BY row_id, epoch_ms) AS c FROM listings),
ref AS (SELECT row_id, max(epoch_ms) - min(epoch_ms) AS gap, count(*) AS n, string_agg(site, ',' ORDER BY site_idx) AS present, first(epoch_ms ORDER BY c DESC, epoch_ms) AS reference FROM counted GROUP BY row_id)
SELECT r.row_id AS cluster_id, present, CASE WHEN n > 1 THEN gap // 60000 ELSE 0 END AS max_diff,
       coalesce(string_agg(site || ':' || ((epoch_ms - reference) // 60000), ',' ORDER BY site_idx) FILTER (epoch_ms <> reference AND n > 1), '') AS deviating,
       (3 - n)::INT AS n_missing, n > 1 AS comparable, n > 1 AND gap > 0 AS is_different
FROM ref r JOIN listings l ON l.row_id = r.row_id GROUP BY ALL""",
    "suggestions": f"""
WITH names AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM part),
pool AS (SELECT DISTINCT lower(p_name) AS canonical, lower(p_name) || ' brand' AS p FROM part),
parts AS (SELECT normalized, canonical, p, string_split(normalized, ' ') AS x, string_split(p, ' ') AS y FROM names, pool),
scored AS (SELECT *, greatest({_RATIO.format("normalized", "p")}, {_RATIO.format(_SORT.format("normalized"), _SORT.format("p"))},
    100.0 * len(list_filter(x, lambda t: list_contains(y, t) OR len(list_filter(y, lambda u: NOT list_contains(x, u) AND t <> u AND (starts_with(t, u) OR starts_with(u, t)))) > 0)) / greatest(len(x), len(y))) AS raw FROM parts)
SELECT normalized, canonical, floor(raw + 0.5) / 100 AS score, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY floor(raw + 0.5) / 100 DESC, canonical) AS nth FROM scored WHERE raw >= 75) WHERE nth <= 3""",
    "unresolved_teams": f"""
WITH {_LISTINGS} SELECT site AS source, sport, {_NORM.format("lower(team)")} AS normalized, count(*) AS records, 'unresolved_team' AS type
FROM (SELECT site, sport, home AS team FROM listings UNION ALL SELECT site, sport, away FROM listings) GROUP BY 1, 2, 3""",
    "report_order": "SELECT 'Ş' || s_suppkey AS name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier",
    "html_text": """
SELECT page_id, md5(D.t) AS text_md5, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS title
FROM pages, LATERAL (SELECT replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t) D""",
    "html_links": """
SELECT page_id, (i - 1)::INT AS at, replace(regexp_extract(tags[i], 'href="([^"]*)"', 1), '&amp;', '&') AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*>') AS tags FROM pages), LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i)""",
    "source_html": """
SELECT 'FUTBOL' AS sport, event_id::VARCHAR AS event_id, 'A & B - L"' || event_id % 4 AS league_key, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, 'h' || user_id AS home, 'a - ' || event_id AS away, 'added' AS state
FROM events WHERE event_id % 2 = 0""",
    "source_tree": """
SELECT 'FUTBOL' AS sport, event_id::VARCHAR AS event_id, event_type || ' - C' || event_id % 9 AS league_key, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS date, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS time, 'h' || user_id AS home, 'a' || event_id AS away, 'added' AS state
FROM events WHERE event_id % 7 <> 0 AND (event_id % 5 = 0 OR event_id % 3 IN (0, 2))""",
    "source_records": """
SELECT CASE event_id % 3 WHEN 0 THEN 'FUTBOL' ELSE 'BASKETBOL' END AS sport, event_id::VARCHAR AS event_id, CASE WHEN event_id % 5 > 0 THEN 'Venue' ELSE 'Land' END || ' - ' || CASE WHEN event_id % 4 = 0 THEN 'P' ELSE 'S' END || event_id % 7 AS league_key,
       strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS date, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS time, 'h' || user_id AS home, 'a' || event_id AS away, 'added' AS state
FROM events WHERE event_id % 10 <> 0 AND event_id % 3 <> 1""",
    "helpers": """
SELECT page_id, regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '[a-zA-Z0-9]{2,}\\.[a-zA-Z0-9]{2,}\\.[a-zA-Z0-9]{2,}') AS is_address, round(page_id::DOUBLE / 3, 2) AS third, (page_id % 5 + 1)::INT AS last FROM pages""",
}
