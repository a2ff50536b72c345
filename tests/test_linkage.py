"""Facts about names, leagues and times, and operators against plain Python models."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import html as H
from kinmatch.functions import similarity as S
from kinmatch.functions import text as T
from kinmatch.functions import timeutil
from kinmatch.operators import collect, matching, report
from kinmatch.operators.aliases import Aliases, canonical_sport, enabled_sports, fold_value
from kinmatch.plans import compare
from kinmatch.sources import connectors, nested, payloads
from kinmatch.streaming.refresh import refresh, store_batch

ALIASES = Aliases.load()


def nothing():
    return F.array().cast("array<string>")


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_folding(spark):
    names = [None, "", "  Bayern MÜNİH ", "Texas A&M", "St.-Pauli’s", "Brøndby", "ﬁn ½ İstanbul ışık", "O`Neil"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.fold(F.col("n"))).collect()]
    assert got == [fold_value(n) for n in names]
    assert got[2:6] == ["bayern munih", "texas am", "st pauli s", "br ndby"]
    labels = [r[0] for r in spark.createDataFrame([("AmericanFootball",), ("Formula1",)], "n string").select(T.fold_label(F.col("n"))).collect()]
    assert labels == ["american football", "formula 1"]


def test_sports(spark):
    names = ["Football", "Soccer", "SOCCER", "Futbol", "Basketball", "Rugby League", "Am. Football", "Quidditch", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(canonical_sport(F.col("n"))).collect()]
    assert got == ["FUTBOL"] * 4 + ["BASKETBOL", "RAGBI", "AMERIKAN_FUTBOLU", "QUIDDITCH", "BILINMEYEN"]
    assert enabled_sports("FUTBOL, tennis nonsense") == ["FUTBOL", "TENIS"] and enabled_sports("") is None


#: (a, b, is it the same team)
TEAMS = [
    ("Arsenal", "Arsenal", True), ("Manchester United FC", "Manchester United", True), ("AS Monaco", "Monaco", True), ("AC Brive", "Brive", True), ("Man Utd", "Manchester United", True),
    ("Paris Saint-Germain", "Paris Saint Germain", True), ("PSG", "Paris Saint-Germain", True), ("Dep. La Guaira", "Deportivo La Guaira", True), ("Bayern Münih", "Bayern Munich", True),
    ("Spartak Moskova", "Spartak Moscow", True), ("Sparta Prag", "AC Sparta Praha", True), ("Zimbabve", "Zimbabwe", True), ("FC Nordsjalland", "Nordsjaelland", True), ("Baracaldo", "Barakaldo", True),
    ("C A Antoniano", "CA Antoniano", True), ("L. A. Galaxy", "LA Galaxy", True), ("QPR", "Queens Park Rangers", True), ("IPK", "Iisalmen Peli-Karhut", True), ("KTP", "Kotkan Tyovaen Palloilijat", True),
    ("Corinthians (W)", "Corinthians SP (Wom)", True), ("Central Cordoba Reserve", "Central Cordoba SdE (Reserves)", True), ("Recek D", "D. Recek", True), ("Andreeva, Mirra", "Mirra Andreeva", True),
    ("Baracaldo", "Real Aviles CF", False), ("Manchester City", "Leicester City", False), ("Real Madrid", "Real Sociedad", False), ("Real Madrid", "Real Betis", False), ("Sporting CP", "Sporting Gijon", False),
    ("Racing Club", "Racing Santander", False), ("HC Kosice", "HK Poprad", False), ("CE Gramadense RS", "Criciuma EC", False), ("Pelotas RS", "Operario Ferroviario EC PR", False),
    ("Barcelona", "Barcelona B", False), ("Barcelona", "Barcelona Women", False), ("Barcelona", "Barcelona (W)", False), ("Manchester United", "Manchester United U21", False), ("River Plate", "River Plate II", False),
    ("Gimnasia La Plata", "Estudiantes de La Plata", False), (None, "Arsenal", False), (None, None, False),
]


def test_teams(spark):
    df = spark.createDataFrame([(k, a, b, "FUTBOL") for k, (a, b, _) in enumerate(TEAMS)], "k int, a string, b string, sport string")
    df = matching.with_team(matching.with_team(df, "a", "sport", ALIASES, "x"), "b", "sport", ALIASES, "y")
    df = df.withColumn("r", matching.compare_teams(F.col("x"), F.col("y"), nothing()))
    got = {r.k: r.r for r in df.select("k", "r").collect()}
    wrong = [(TEAMS[k], r) for k, r in got.items() if (r.score >= 78) != TEAMS[k][2]]
    assert not wrong
    assert got[0].stage == "exact" and got[4].stage in ("exact", "alias")
    assert got[[t[:2] for t in TEAMS].index(("Barcelona", "Barcelona B"))].reason == "qualifier-mismatch"


def test_city_abbreviations_need_capitals_and_a_us_sport(spark):
    rows = [("LA Lakers", "BASKETBOL"), ("La Coruna", "BASKETBOL"), ("LA Galaxy X", "FUTBOL"), ("Deportivo La Coruna", "FUTBOL")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, s string").select(ALIASES.normalize_team(F.col("n"), F.col("s"))).collect()]
    assert got[0] == "los angeles lakers" and not any("angeles" in x for x in got[1:])


#: (sport, a, b, reason of a rejection, score if it is fixed)
LEAGUES = [
    ("FUTBOL", "England - Premier League", "England - English Premier League", None, 100), ("FUTBOL", "England - Premier League", "Belarus - Premier League", "different-country", 0),
    ("FUTBOL", "Holland - Eredivisie", "Netherlands - Eredivisie", None, 100), ("FUTBOL", "Turkey - Super Lig", "Turkiye - Super Lig", None, 100),
    ("FUTBOL", "International Clubs - UEFA Champions League", "Europe - UEFA Champions League - League Stage", None, 100), ("RAGBI", "Rugby Union - France Top 14", "France - Top 14", None, None),
    ("FUTBOL", "Argentina - Primera Division", "Argentina - Primera Division, Women", "league-qualifier-mismatch", 0), ("FUTBOL", "England - Premier League", "England - Championship", "different-canonical-league", 0),
]


def test_leagues(spark):
    df = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(LEAGUES)], "k int, sport string, a string, b string")
    df = ALIASES.with_league(ALIASES.with_league(df, "sport", "a", "x"), "sport", "b", "y")
    df = df.withColumn("r", matching.compare_leagues(F.col("x"), F.col("y"), F.col("sport"), nothing(), nothing()))
    for r in df.collect():
        _, _, _, reason, score = LEAGUES[r.k]
        assert r.r.reason == reason and (score is None or r.r.score == score), LEAGUES[r.k]
    ids = [r.x.canonical_id for r in df.orderBy("k").collect()]
    assert ids[0] == "england_premier_league" and ids[4] == "uefa_champions_league"
    same = one(spark, T.league_name(F.lit("Turkiye Super Lig 2026/2027")), T.league_name(F.lit("Turkiye Super Lig")))
    assert same.c0 == same.c1


def test_times(spark):
    e = lambda d, t, o=180: timeutil.epoch_ms(F.lit(d), F.lit(t), o)
    r = one(spark, e("2026-09-24", "20:00"), e("2026-09-24", None), e(None, "20:00"), e("2026-09-24", "25:00"), timeutil.minutes_between(e("2026-09-24", "23:50"), e("2026-09-25", "00:10")), e("2026-09-24", "00:30") - e("2026-09-23", "21:30", 0), e("2026-02-31", "03:00"), e("bad", "20:00"))
    assert list(r) == [1790269200000, None, None, None, 20, 0, 1772496000000, None]
    days = one(spark, *(timeutil.shifted_day(F.lit(d), n) for d, n in (("2026-09-24", 1), ("2026-09-01", -1), ("2027-01-01", -1), ("gecersiz", 1))))
    assert list(days) == ["2026-09-25", "2026-08-31", "2026-12-31", None]
    c = one(spark, timeutil.compare_times(F.lit("2026-09-26"), e("2026-09-26", "06:00"), F.lit("2026-09-26"), e("2026-09-26", "22:00")), timeutil.compare_times(F.lit("a"), F.lit(None).cast("bigint"), F.lit("a"), F.lit(5).cast("bigint")))
    assert tuple(c.c0) == (960, True, True, True) and tuple(c.c1) == (None, False, False, True)
    local = one(spark, timeutil.local_from_ms(F.lit(0)), timeutil.local_from_seconds(F.lit(None).cast("bigint")), timeutil.parse_local(F.lit("2026-01-02T03:04:05")), timeutil.parse_local(F.lit(None).cast("string")))
    assert [tuple(x) for x in local] == [("1970-01-01", "02:00"), ("UNKNOWN_DATE", ""), ("2026-01-02", "03:04"), ("UNKNOWN_DATE", "")]


def plain_overlap(a, b):
    from kinmatch.resources.words import WEAK_TOKENS

    ta, tb = a.split(), b.split()
    if not ta or not tb:
        return 0.0
    left, score = list(tb), 0
    for x in ta:
        hit = next((j for j, y in enumerate(left) if y == x), None)
        if hit is None:
            hit = next((j for j, y in enumerate(left) if y and y != x and (x.startswith(y) or y.startswith(x))), None)
        if hit is not None:
            left[hit], score = "", score + 1
    weigh = lambda ts: sum(0.5 if t in WEAK_TOKENS else 1 for t in ts)
    return min(100.0, 100 * score / max(weigh(ta), weigh(tb)))


def test_token_overlap_equals_the_plain_one(spark):
    r = random.Random(3)
    words = ["city", "real", "a", "ab", "abc", "b", "bcd", "x", "united"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 4))), " ".join(r.choices(words, k=r.randint(0, 4)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.token_overlap(F.col("a"), F.col("b")).alias("s"), S.similarity(F.col("a"), F.col("b")).alias("t")).collect()
    assert all(abs(x.s - plain_overlap(x.a, x.b)) < 1e-9 and 0 <= x.t <= 100 for x in got)


def listing(site, row, home, away, sport="FUTBOL", league="England - Premier League", date="2026-09-24", time="20:00"):
    return ("abc"[site], site, row, sport, league, date, time, home, away)


def features(spark, rows):
    df = spark.createDataFrame(rows, "site string, site_idx int, row_id bigint, sport string, league_raw string, date string, time string, home string, away string")
    df = df.withColumn("epoch_ms", timeutil.epoch_ms(F.col("date"), F.col("time"))).withColumn("league", F.col("league_raw")).withColumn("event_id", F.lit(""))
    return matching.saved(matching.with_features(df, ALIASES))


#: (change of the second listing, candidates, is it a match, reason)
PAIRS = [
    ({"sport": "BASKETBOL"}, 0, None, None), ({"date": "2026-10-05"}, 0, None, None), ({"date": "2026-09-25", "time": "00:10"}, 1, True, None), ({"home": "Bayern Munich", "away": "Dortmund"}, 0, None, None),
    ({"home": "Man Utd", "away": "Arsenal FC"}, 1, True, None), ({"home": "Manchester City", "away": "Arsenal"}, 1, False, "team-below-threshold"), ({"league": "England - Championship"}, 1, False, "different-canonical-league"),
    ({"home": "Arsenal", "away": "Manchester United"}, 1, True, None), ({"time": ""}, 1, True, None),
]


@pytest.mark.parametrize("change,n,ok,reason", PAIRS)
def test_pairs(spark, change, n, ok, reason):
    rows = features(spark, [listing(0, 0, "Manchester United", "Arsenal", time="23:50"), listing(1, 0, **({"home": "Manchester United", "away": "Arsenal", "time": "23:50"} | change))])
    candidates = matching.candidate_pairs(rows)
    assert candidates.count() == n
    if n:
        r = matching.score_pairs(candidates, rows).first()
        assert (r.reason is None) == ok and r.reason == reason and 0 <= r.confidence <= 1
        assert r.flipped == (change.get("home") == "Arsenal") or not ok


def test_nearer_time_is_surer(spark):
    rows = features(spark, [listing(0, 0, "A Team", "B Side", "BEYZBOL", "United States - MLB", time="14:05"), listing(1, 0, "A Team", "B Side", "BEYZBOL", "United States - MLB", time="14:00"), listing(1, 1, "A Team", "B Side", "BEYZBOL", "United States - MLB", time="20:00")])
    got = {r.b & 1: r.confidence for r in matching.score_pairs(matching.candidate_pairs(rows), rows).collect()}
    assert got[0] > got[1]


def greedy(edges):
    used, out = set(), set()
    for e in sorted(edges, key=lambda e: (e[2], e[3], -e[4], e[0], e[5], e[6], e[1])):
        a, b, sa, sb = e[:4]
        if (sa, sb, 0, a) not in used and (sa, sb, 1, b) not in used:
            used |= {(sa, sb, 0, a), (sa, sb, 1, b)}
            out.add((a, b))
    return out


EDGES = "a bigint, b bigint, site_a int, site_b int, rank double, day_offset int, prefix_pos int"


@pytest.mark.parametrize("rounds", [1, 12])
def test_assignment_equals_sequential_greedy(spark, rounds):
    r = random.Random(rounds)
    edges = {(sa * 100 + r.randrange(25), sb * 100 + r.randrange(25)): (sa, sb, float(r.randrange(4)), r.choice([-1, 0]), r.randrange(3)) for _ in range(500) for sa, sb in [r.choice([(0, 1), (0, 2), (1, 2)])]}
    rows = [(a, b, *v) for (a, b), v in edges.items()]
    got = matching.assign(spark.createDataFrame(rows, EDGES), rounds).collect()
    assert {(x.a, x.b) for x in got} == greedy(rows) and len(got) == len(greedy(rows))


def test_clusters_have_one_row_of_a_site_and_equal_a_replay(spark):
    r = random.Random(8)
    edges = {(sa * 100 + r.randrange(20), sb * 100 + r.randrange(20)): (sa, sb, r.random(), 0, 0) for _ in range(90) for sa, sb in [r.choice([(0, 1), (0, 2), (1, 2)])]}
    rows = [(a, b, *v) for (a, b), v in edges.items()]
    home, members = {}, {}
    for a, b, sa, sb, *_ in sorted(rows, key=lambda e: (e[2], e[3], -e[4], e[0], e[1])):
        for x in (a, b):
            home.setdefault(x, x)
            members.setdefault(home[x], {home[x]})
        x, y = home[a], home[b]
        if x != y and not {m // 100 for m in members[x]} & {m // 100 for m in members[y]}:
            members[x] |= members.pop(y)
            home |= dict.fromkeys(members[x], x)
    nodes = spark.createDataFrame([(s * 100 + k,) for s in range(3) for k in range(20)], "rid bigint")
    groups = defaultdict(set)
    for x in matching.cluster(nodes, spark.createDataFrame(rows, EDGES)).collect():
        groups[x.cluster_id].add(x.rid)
    want = {frozenset(m) for m in members.values()} | {frozenset([s * 100 + k]) for s in range(3) for k in range(20) if s * 100 + k not in home}
    assert {frozenset(g) for g in groups.values()} == want
    assert all(len({m // 100 for m in g}) == len(g) for g in groups.values())


DOCUMENT = {"Football": {"England - EPL": {"2026-09-24": [{"eventId": 7, "leagueId": "1", "home": "Man Utd", "away": "Arsenal", "time": "20:00"}], "2026-09-25": "broken"}, "x": None}, "other": []}


def test_files_are_compared_and_broken_ones_left_out(spark, tmp_path):
    other = json.loads(json.dumps(DOCUMENT).replace("20:00", "20:30").replace("Man Utd", "Manchester United"))
    files = {"one-matches.json": json.dumps(DOCUMENT), "two_match.json": json.dumps(other), "bad.json": "{", "list.json": "[1]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    done, unreadable = compare.compare_files(spark, [str(tmp_path / n) for n in files])
    assert done.sites == ["one", "two"] and {u["path"].rpartition("/")[2] for u in unreadable} == {"bad.json", "list.json"}
    out = compare.envelope(done, unreadable)
    assert {k: out["summary"][k] for k in ("groups", "comparable", "different", "same")} == {"groups": 1, "comparable": 1, "different": 1, "same": 0}
    row = done.discrepancies().first()
    assert row.max_diff_minutes == 30 and row.times == {"one": "20:00", "two": "20:30"} and row.deviating_sites[0].minutes == 30
    assert compare.format_times(row.asDict(recursive=True), done.sites) == "one: 20:00   two: 20:30 (+30)"
    with pytest.raises(ValueError):
        compare.compare_files(spark, [str(tmp_path / "one-matches.json"), str(tmp_path / "bad.json")])
    main = compare.main([str(tmp_path / "one-matches.json"), str(tmp_path / "two_match.json"), "-o", str(tmp_path / "out.json"), "--flat", "--unmatched"])
    assert json.loads((tmp_path / "out.json").read_text())["discrepancies"][0]["home"] == "Man Utd" and main["unmatched"] == []


def test_last_of_equal_keys_counts(spark):
    text = '{"FUTBOL": {"L": {"2026-01-01": []}}, "FUTBOL": {"L": {"2026-01-02": [{"home": "h", "away": "a"}]}}}'
    rows = nested.parse_documents(spark.createDataFrame([("s", 0, text)], "site string, site_idx int, document string")).collect()
    assert [(r.date, r.home, r.time) for r in rows] == [("2026-01-02", "h", None)]


def test_aliases_from_an_unreadable_file_are_empty(tmp_path):
    stats = Aliases.load(tmp_path / "none.json").stats()
    assert {"teams", "team_aliases", "countries", "regions", "leagues", "league_aliases"} <= set(stats) and set(stats.values()) == {0}


def test_collecting_nesting_and_writing(spark, tmp_path):
    rows = [("FUTBOL", "1", "9", "L", "C", "2026-01-01", "10:00", "h", "a", 0), ("FUTBOL", "1", "9", "L", "C", "2026-01-01", "10:00", "h", "a", 1), ("FUTBOL", "", None, None, None, "2026-01-01", "09:00", "h2", "a2", 2), ("FUTBOL", "", None, None, None, "2026-01-01", "09:00", "h2", "a2", 3), ("", "5", "", "", "", "2026-01-01", "", "h", "a", 4), ("FUTBOL", "6", "4", None, None, "2027-01-01", "", "h", "a", 5)]
    df = spark.createDataFrame(rows, "sport string, event_id string, league_id string, league_name string, country_name string, date string, time string, home string, away string, arrival int")
    got = collect.collect_events(df, "arrival", last="2026-12-31")
    assert tuple(collect.counters(got).first()) == (3, 1, 1, 1)
    tree = collect.nested(got.where("state = 'added'"))
    assert [r.sport for r in tree.collect()] == ["FUTBOL", "BASKETBOL", "VOLEYBOL", "TENIS"]
    document = collect.document(tree)
    assert nested.write_document(document, str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert list(back["FUTBOL"]) == ["BILINMEYEN_LIG", "C - L"] and len(back["FUTBOL"]["BILINMEYEN_LIG"]["2026-01-01"]) == 2
    assert not nested.write_document(document.limit(0), str(tmp_path / "out"))


def test_html(spark):
    r = one(spark, H.decode_entities(F.lit("a&#x41;&#66;&amp;lt;&nope;&#x1F600;")), H.strip_tags(F.lit("<p>a <b>b</b>&amp;c</p>")), H.attributes(F.lit("<i id=\"1\" Class='x y' data-a=\"&quot;\" id='2'>")))
    assert r.c0 == "aAB&lt;&nope;😀" and r.c1 == "a b &c" and r.c2 == {"id": "2", "class": "x y", "data-a": '"'}


MENU = """<i id="check__1" class="b-check sport" layout="LC"></i><span class="sport-name">Futbol</span><i id="check__11" class="b-check stage"></i><i id="check__11" class="b-check stage">
<i id="check__2" class="b-check sport" layout=""></i><span class='x sport-name y'>Tenis</span><i id="check__21" class="b-check stage"></i><i id="check__3" class="b-check sport" layout="Z"></i><span class="sport-name">Quidditch</span>"""


def test_html_site(spark):
    event = json.dumps({"mid": 5, "lid": 11, "sport_id": 1, "event": "A - B - C", "event_start_time": "2026-01-02 03:04:00", "league_name": "L", "country_name": "C"}).replace('"', "&quot;")
    captured = spark.createDataFrame([("menu", None, MENU), ("events", "1", f'<a rev="{event}"></a><a rev="{event}"></a><a rev="no"></a>')], "kind string, sport_no string, payload string")
    menu = payloads.parse_menu(captured.where("kind = 'menu'").select(F.col("payload").alias("html")))
    assert [(r.sport_no, r.name, r.layout, r.league_ids) for r in menu.orderBy("at").collect()] == [("1", "Futbol", "LC", ["11"]), ("2", "Tenis", "", ["21"]), ("3", "Quidditch", "Z", [])]
    rows = connectors.site_events("html", captured).collect()
    assert [(r.sport, r.home, r.away, r.date, r.time, r.league_key, r.state) for r in rows] == [("FUTBOL", "A", "B - C", "2026-01-02", "03:04", "C - L", "added")]
    assert connectors.events_url("http://x", ["1", "2"], "LC").startswith("http://x/getdata.php?sec=ASIAN_LAYOUT&subsec=REQUEST_GET_SCHEME_EVENTS&league_id%5B%5D=1&")


def test_tree_site(spark):
    game = {"id": "9", "team1_name": "A", "team2_name": "B", "start_ts": 0, "show_type": "", "type": 0}
    tree = {"sport": {"1": {"id": "1", "name": "Football", "region": {"2": {"id": "2", "name": "R", "competition": {"3": {"id": "3", "name": "C", "game": {"9": game, "8": game | {"id": "8", "show_type": "OUTRIGHT"}, "7": game | {"id": "7", "type": 1}}}}}}}}}
    rows = connectors.site_events("tree", spark.createDataFrame([("games", "FUTBOL", json.dumps(tree))], "kind string, sport string, payload string")).collect()
    assert [(r.event_id, r.league_key, r.date, r.time) for r in rows] == [("9", "R - C", "1970-01-01", "02:00")]
    found = json.dumps({"sport": {"1": {"id": "1", "alias": "Football", "region": {"2": {"name": "R", "competition": {"3": {"id": "3", "name": "C", "game": 4}, "4": {"id": "4", "name": "D", "game": 0}}}}}}})
    assert [r.competition_id for r in payloads.competitions(spark.createDataFrame([(found,)], "payload string")).collect()] == ["3"]


def test_record_site(spark):
    sports = [{"_type": "SPORT", "id": "1", "name": "Football", "numberOfUpcomingMatches": 3}, {"_type": "SPORT", "id": "2", "name": "Tennis", "numberOfUpcomingMatches": 9, "isVirtual": True}]
    matches = [{"_type": "MATCH", "id": "5", "sportId": "1", "startTime": 0, "shortParentName": "", "parentName": "Long", "venueName": "V", "homeParticipantName": "A", "awayParticipantName": "B"}, {"_type": "MATCH", "id": "6", "sportId": "2"}]
    rows = connectors.site_events("records", spark.createDataFrame([("sports", json.dumps(sports)), ("matches", json.dumps(matches))], "kind string, payload string")).collect()
    assert [(r.event_id, r.sport, r.league_key) for r in rows] == [("5", "FUTBOL", "V - Long")]
    with pytest.raises(ValueError):
        connectors.site_events("nowhere", spark.range(1))


def test_requests_are_retried_and_failures_are_rows(spark):
    waits, answers = [], [TimeoutError(), ConnectionError(), "ok"]

    def get(url, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert connectors.fetch("u", get, sleep=waits.append) == "ok" and len(waits) == 2 and all(0 <= w <= 20 for w in waits)
    with pytest.raises(KeyError):
        connectors.fetch("u", lambda *_: {}["no"], sleep=waits.append)
    assert connectors.chunked(["a", "b", "c"], 2) == [["a", "b"], ["c"]]
    rows = connectors.request(spark, ["http://127.0.0.1:9/x"], timeout=1, attempts=1).collect()
    assert rows[0].payload is None and rows[0].error


def test_refresh_replaces_only_the_sites_that_sent_rows(spark, tmp_path):
    stored, source = str(tmp_path / "stored"), tmp_path / "in"
    schema = "site string, sport string, home string"
    store_batch(spark.createDataFrame([("a", "FUTBOL", "old"), ("b", "FUTBOL", "old")], schema), stored)
    spark.createDataFrame([("a", "FUTBOL", "new"), ("b", "nonsense", "new")], schema).write.parquet(str(source))
    seen = []
    refresh(spark.readStream.schema(schema).parquet(str(source)), stored, str(tmp_path / "cp"), after=seen.append, once=True).awaitTermination()
    assert {(r.site, r.home) for r in spark.read.parquet(stored).collect()} == {("a", "new"), ("b", "old")} and seen == [["a"]]


def test_report_order(spark):
    rows = [("item10",), ("item2",), ("İtem1",), ("Çan",), ("cam",)]
    got = [r.n for r in spark.createDataFrame(rows, "n string").orderBy(report.turkish(F.col("n"))).collect()]
    assert got.index("item2") < got.index("item10") and got.index("cam") < got.index("item2")


def named_rows(spark, names):
    """Features of the same names on three sites, on days around a month's end, some of other countries or without one."""
    rows = []
    for k, (home, away) in enumerate(names):
        for site in range(3):
            day = ("2024-02-28", "2024-02-29", "2024-03-01", "bad")[(k + site) % 4]
            h, a = (away, home) if (k + site) % 5 == 4 else (home, away)
            rows.append((f"s{site}", site, k, "FUTBOL", "L", ("England - L", "Spain - L", "L", "Europe - L")[(k * (site + 1)) % 4], day, "10:00", 1709200000000, h, a, f"e{k}"))
    columns = "site string, site_idx int, row_id bigint, sport string, league string, league_raw string, date string, time string, epoch_ms bigint, home string, away string, event_id string"
    return matching.saved(matching.with_features(spark.createDataFrame(rows, columns), Aliases.load()))


NAMES = [("Real City", "Sporting United"), ("Man Utd", "Kolma Verdi"), ("Manchester United", "Kolma Verdy"), ("K V", "Kolma Verdi"), ("KV", "Olma Verdi"), ("Kol Ver", "PSG"), ("Paris Saint-Germain", "Xolma Verdi"), ("", "Tarn"), ("Tarn W", "A. B. Tarnov"), ("Tarn", "AB Tarnow"), ("United", "City"), ("Verdi Kolma", "Man United U21")]


def test_each_candidate_comes_once_by_its_first_key_without_a_shuffle_of_pairs(spark):
    rows = named_rows(spark, NAMES)
    pairs = matching.candidate_pairs(rows)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    local = rows.select("rid", "site_idx", "date", "signature").collect()
    days = {"2024-02-28": 0, "2024-02-29": 1, "2024-03-01": 2}
    want = set()
    for x in local:
        for y in local:
            off = 0 if x.date == y.date else days[y.date] - days[x.date] if x.date in days and y.date in days else 9
            at = [k for k, key in enumerate([*x.signature, ""]) if key in (y.signature or [""])]
            if x.site_idx < y.site_idx and abs(off) <= 1 and at:
                want.add((x.rid, y.rid, off, at[0]))
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_pruned_candidates_lose_no_pair_that_scoring_keeps(spark):
    rows = named_rows(spark, NAMES)
    every, likely = matching.saved(matching.candidate_pairs(rows)), matching.saved(matching.likely_pairs(rows))
    keys = ["a", "b", "day_offset", "prefix_pos"]
    assert likely.select(keys).exceptAll(every.select(keys)).isEmpty() and 0 < likely.count() < every.count()
    kept = [{tuple(r) for r in matching.score_pairs(p, rows).where("reason is null").collect()} for p in (every, likely)]
    assert kept[0] == kept[1] and kept[0]


def test_likeness_of_facts_is_similarity(spark):
    r = random.Random(5)
    words = ["city", "real", "a", "ab", "abc", "b", "bcd", "x", "united", "rcu", "kolma", "kolmar", "1st", "aab"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 4))), " ".join(r.choices(words, k=r.randint(0, 4)))) for _ in range(400)] + [(None, "a"), ("a", None), ("", "")]
    df = matching.saved(spark.createDataFrame(rows, "a string, b string").select("a", "b", S.likeness_facts(F.col("a")).alias("x"), S.likeness_facts(F.col("b")).alias("y")))
    got = df.select(S.similarity(F.col("a"), F.col("b")).alias("s"), S.likeness(F.col("x"), F.col("y")).alias("t")).collect()
    assert all(g.s == g.t for g in got) and len({g.s for g in got}) > 10


@pytest.mark.parametrize("limit", [50_000, 0])
def test_candidates_are_scored_where_they_are_joined(spark, monkeypatch, limit):
    rows = []
    for k, (home, away) in enumerate([*NAMES, (None, "Tarn"), ("Kolma U21", "Verdi W")]):
        for site in range(3):
            h, a = (away, home) if (k + site) % 5 == 4 else (home, away)
            sport, league = ("FUTBOL", "BASKETBOL", "TENIS")[k % 3 if k > 6 else 0], ("England - L", "Spain - L U21", "L", "Europe - L", None)[(k * (site + 1)) % 5]
            rows.append((f"s{site}", site, k, sport, league, ("2024-02-28", "2024-02-29", "2024-03-01", "bad", None)[(k + site) % 5], "10:00", 1709200000000 if k % 4 else None, h, a))
    listings = spark.createDataFrame(rows, "site string, site_idx int, row_id bigint, sport string, league_raw string, date string, time string, epoch_ms bigint, home string, away string")
    aliases = Aliases.load()
    featured = matching.saved(matching.with_features(listings, aliases))
    want = {tuple(x) for x in matching.score_pairs(matching.saved(matching.candidate_pairs(featured)), featured).collect()}
    monkeypatch.setattr(matching, "DIM_BROADCAST_ROWS", limit)
    out = matching.score_candidates(listings, aliases)
    got = [tuple(x) for x in out.collect()]
    assert set(got) == want and len(got) == len(want) > 50 and len({g[12] for g in got}) >= 3
    # Only rows are shuffled, for the one join that makes the pairs; names are looked up in it.
    if limit:
        plan = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1


def test_near_names_are_all_that_comparing_lets_pass(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(30)] + ["united", "city", "utd", "real"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(60)] + [n for pair in NAMES for n in pair]
    for n in names[:40]:
        k = r.randrange(len(n))
        names.append(n[:k] + r.choice("ab") + n[k + r.randint(0, 1) :])
    df = matching.saved(matching.with_team(spark.createDataFrame([(n, "FUTBOL") for n in dict.fromkeys(names)], "n string, sport string"), "n", "sport", ALIASES, "f").select(F.xxhash64("f").alias("t"), "f").dropDuplicates(["t"]))
    every = df.select(F.col("t").alias("x"), F.col("f").alias("fx")).crossJoin(df.select(F.col("t").alias("y"), F.col("f").alias("fy")))
    quals = F.concat(*(F.col(f"{f}.{c}.quals") for f in ("fx", "fy") for c in ("plain", "initials")))
    for threshold in (78, 60):
        opt = matching.Options(team_threshold=threshold)
        scored = every.select("x", "y", matching.compare_teams(F.col("fx"), F.col("fy"), quals, opt)["score"].alias("score")).where(F.col("score") >= threshold)
        want = {(x.x, x.y, round(x.score, 6)) for x in scored.collect()}
        got = [(x.x, x.y, round(x.score, 6)) for x in matching.near_names(df.select("t", matching._team_facts(F.col("f")).alias("facts")), opt).collect()]
        assert set(got) == want and len(got) == len(want) > df.count()


def test_matching_joins_rows_of_near_names_only_and_shuffles_no_pair(spark):
    rows = named_rows(spark, NAMES)
    named = matching._Named.of(rows)
    plan = matching._met(named, matching.Options())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
