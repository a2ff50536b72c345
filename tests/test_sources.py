"""Requests, sessions over a made-up transport, and what is stored between rounds."""

import json

import pytest
from pyspark.sql import functions as F

from kinmatch.functions import misc
from kinmatch.operators.collect import upsert
from kinmatch.plans import queries
from kinmatch.sources import connectors, payloads, sessions, stored

MENU = '<I class="b-check sport" id="check__1" layout="LC"></I><span class="sport-name">Football</span><i class="b-check stage" id="check__11"></i><i class="b-check stage" id="check__12"></i><i class="b-check stage" id="check__13"></i>'


def site():
    def page(url, timeout):
        """A made-up site: a menu, events of two leagues, and one request that fails."""
        if url.endswith("/menu"):
            return MENU
        if "=13" in url:
            raise ConnectionError("gone")
        event = lambda mid: json.dumps({"mid": mid, "lid": 11, "sport_id": 1, "event": f"A{mid} - B", "event_start_time": "2026-01-02 03:04:00", "league_name": "L", "country_name": "C"}).replace('"', "&quot;")
        return "".join(f'<a rev="{event(m)}"></a>' for m in (("1", "2") if "=11" in url else ("2", "3")))

    return page


def test_html_source_from_menu_to_events_with_counters_and_quarantine(spark, tmp_path):
    options = connectors.FetchOptions(delay=0, attempts=1, leagues_a_request=1)
    events, asked = connectors.collect_html(spark, "http://x", "http://x/menu", site(), options)
    assert sorted((r.sport, r.event_id, r.home) for r in events.collect()) == [("FUTBOL", "1", "A1"), ("FUTBOL", "2", "A2"), ("FUTBOL", "3", "A3")]
    assert connectors.counters(asked).first().asDict() | {"bytes": 0} == {"requests": 4, "retries": 0, "failed": 1, "bytes": 0}
    assert connectors.quarantine(asked, str(tmp_path / "failed")) and "gone" in spark.read.json(str(tmp_path / "failed")).first().error
    assert not connectors.quarantine(asked.where("error is null"), str(tmp_path / "none"))


def test_captures_do_not_mix(spark):
    other = MENU.replace("check__1\"", "check__2\"").replace("Football", "Tennis").replace("check__11", "check__21")
    menus = spark.createDataFrame([(MENU,), (other,), (MENU,)], "html string")
    assert sorted((r.sport_no, r.name, tuple(r.league_ids)) for r in payloads.parse_menu(menus).collect()) == [("1", "Football", ("11", "12", "13")), ("2", "Tennis", ("21", "12", "13"))]


def test_rate_options_and_addresses(spark):
    now, waits = [0.0], []
    limiter = connectors.RateLimiter(2, lambda: now[0], waits.append)
    for _ in range(3):
        limiter.acquire()
    now[0] = 100
    limiter.acquire()
    assert waits == [2, 4]
    env = {"MATCH_SPORTS": "Football, tennis", "ONE_CONCURRENCY": "5", "ONE_REQUEST_DELAY_MS": "80", "ONE_RETRY_ATTEMPTS": "x", "MATCH_FETCH_INTERVAL_MS": "1000", "MATCH_FETCHER_LOG_LEVEL": "warn"}
    o = connectors.FetchOptions.from_environment("one", env)
    assert (o.sports, o.concurrency, o.delay, o.attempts, o.interval, o.log_level) == (("FUTBOL", "TENIS"), 5, 0.08, 3, 1.0, "warn")
    row = spark.range(1).select(misc.fixed(F.lit("3.14159")).alias("a"), misc.fixed(F.lit("x")).alias("b"), misc.span(2, 4).alias("c"), misc.span(4, 2).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (3.14, None, [2, 3, 4], []) and len(misc.code(9)) == 9


class Wire:
    """A transport that answers by a function of what was sent; None is silence, an exception is raised."""

    def __init__(self, answer):
        self.answer, self.out, self.sent = answer, [], []

    def send(self, text):
        self.sent.append(json.loads(text))
        self.out += self.answer(self.sent[-1])

    def receive(self, timeout):
        if not self.out:
            raise TimeoutError("silence")
        got = self.out.pop(0)
        if isinstance(got, Exception):
            raise got
        return got if isinstance(got, str) else json.dumps(got)

    def close(self):
        self.out = None


def test_tree_session_matches_answers_and_opens_again():
    lost = [ConnectionError("lost")]

    def answer(m):
        if m["command"] == "request_session":
            return [{"rid": m["rid"], "code": 0, "data": {"sid": "s"}}]
        if lost:
            return [lost.pop()]
        if m["params"].get("where") == {"bad": 1}:
            return [{"rid": m["rid"], "code": 5, "msg": "no"}]
        return ["not json", {"push": 1}, {"rid": "another", "code": 0, "data": 1}, {"rid": m["rid"], "code": 0, "data": {"data": {"sport": {}}}}]

    client = sessions.TreeSession(lambda: Wire(answer), sleep=lambda _: None)
    assert client.get({"sport": ["id"]}) == {"sport": {}} and client.stats["reconnects"] == 1 and client.stats["retries"] == 1
    with pytest.raises(sessions.Refused):
        client.get({"sport": ["id"]}, {"bad": 1})
    assert client.dump("get", {"where": {"bad": 1}}) is None and len(client.failed()) == 2
    client.close()


def test_record_session_and_the_walk():
    asked = []
    answers = {
        "locations/1": [{"_type": "LOCATION", "id": 7}, {"_type": "LOCATION", "id": 8, "numberOfUpcomingMatches": 0}, {"_type": "LOCATION", "id": 9}],
        "tournaments/1/7": [{"_type": "TOURNAMENT", "id": 70}, {"_type": "TOURNAMENT", "id": 71}], "tournaments/1/9": [{"_type": "TOURNAMENT", "id": 90}],
        "a/70": [], "b/70": [{"_type": "MATCH", "id": 1, "sportId": 1}], "b/71": [{"_type": "MATCH", "id": 2, "sportId": "1"}, {"_type": "MATCH", "id": 3, "sportId": "2"}], "b/90": [{"_type": "MATCH", "id": 4, "sportId": "1"}],
    }

    def answer(m):
        if m[0] == sessions.HELLO:
            return [[sessions.WELCOME, 1, {}]]
        topic = m[5]["topic"]
        asked.append(topic)
        if topic == "bulk":
            return [[sessions.ERROR, sessions.CALL, m[1], {}, "denied"]]
        return [[sessions.EVENT, 1, 2, {}], [sessions.RESULT, m[1], {}, [], {"records": answers.get(topic, [])}]]

    client = sessions.RecordSession(lambda: Wire(answer), sleep=lambda _: None)
    walk = sessions.Walk(client.dump, "locations/{sport}", "tournaments/{sport}/{id}", ("a/{id}", "b/{id}"))
    found = sessions.bulk_or_walk(client.dump("bulk"), walk, "1")
    assert [r["id"] for r in found] == [1, 2, 4] and walk.working == "b/{id}"
    assert asked.count("a/70") == 1 and "a/71" not in asked and len(client.failed()) == 1
    walk.most_branches = 1
    assert [r["id"] for r in walk.matches("1")] == [1, 2]
    assert sessions.bulk_or_walk([], walk, "1") == []


def test_what_is_stored_between_rounds(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("a", 1), ("b", 2)], "site string, n int").write.partitionBy("site").parquet(folder + "/rows")
    assert [r.n for r in stored.stored_listings(spark, folder + "/rows", "b").collect()] == [2] and stored.stored_listings(spark, folder + "/rows").count() == 2
    sites = spark.createDataFrame([("a", "old", 1)], "site string, link string, site_no int").select("site", "link")
    new = stored.save_site_link(sites, spark.createDataFrame([("a", "new"), ("b", "x")], "site string, link string"), ["a", "b"])
    assert sorted(map(tuple, stored.site_links(new).collect())) == [("a", "new"), ("b", "x")]
    with pytest.raises(ValueError):
        stored.save_site_link(sites, spark.createDataFrame([("z", "x")], "site string, link string"), ["a", "b"])
    assert stored.last_report(spark, folder + "/report.json") is None and stored.status(spark, folder + "/status") == "idle"
    for raw in ('{"a": 1}', '{"a": [2, "ş"]}'):
        stored.save_report(spark, folder + "/report.json", raw)
        assert stored.last_report(spark, folder + "/report.json") == json.loads(raw)
    stored.set_status(spark, folder + "/status", "running")
    assert stored.status(spark, folder + "/status") == "running"
    numbered = stored.with_site_number(spark.createDataFrame([("a", 5), ("q", 6)], "site string, n int"), spark.createDataFrame([("a", 1)], "site string, site_no int"))
    assert [tuple(r) for r in numbered.collect()] == [("a", 5, 1)]


def test_the_last_change_of_a_key_counts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k int, v string, at int")
    assert sorted(map(tuple, upsert(old, changes, "k", "at").collect())) == [(1, "x"), (2, "b"), (3, "z")]


def answers_of(spark, folder, query, monkeypatch):
    """The captured answers that a query over 3,000 events of two types parses, and its rows."""
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_dt_interval(0, 0, int(id % 999)) AS ts, id % 7 AS user_id, if(id % 2 = 0, 'view', 'click') AS event_type FROM range(3000)").write.parquet(f"{folder}/events.parquet")
    captured, whole = [], connectors.site_events
    monkeypatch.setattr(queries, "_ANSWER_IDS", 500)
    monkeypatch.setattr(connectors, "site_events", lambda site, df: captured.append(df) or whole(site, df))
    rows = query(spark, folder)
    return captured[0], rows


def hashed_below_explode(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate" in plan and "xxhash64" in plan and "xxhash64" not in plan[: plan.rindex("Generate")]


def test_tree_answers_are_bounded_and_hashed_once(spark, tmp_path, monkeypatch):
    captured, rows = answers_of(spark, str(tmp_path), queries.source_tree, monkeypatch)
    assert captured.count() == 12 and rows.count() == sum(k % 7 > 0 and (k % 5 == 0 or k % 3 != 1) for k in range(3000))
    assert hashed_below_explode(payloads.tree_events(spark.createDataFrame([("{}", "FUTBOL")], "payload string, sport string"), F.col("sport")))


def test_bulk_answers_are_bounded_and_hashed_once(spark, tmp_path, monkeypatch):
    captured, rows = answers_of(spark, str(tmp_path), queries.source_records, monkeypatch)
    assert captured.where("kind = 'matches'").count() == 12 and rows.count() == sum(k % 10 > 0 and k % 3 != 1 for k in range(3000))
    assert hashed_below_explode(payloads.records(spark.createDataFrame([("[]",)], "payload string")))
