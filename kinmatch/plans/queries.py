"""Queries over the driver's tables, one or more for each group of operators.

The tables have no fixtures, so `listings` makes three sites out of events: the same fixtures with
spellings, times and days changed by fixed rules.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import html as H
from kinmatch.functions import similarity as S
from kinmatch.functions import text as T
from kinmatch.functions import misc, timeutil
from kinmatch.operators import collect, matching, report, suggest
from kinmatch.operators.aliases import Aliases, canonical_sport, sport_of, sport_rank
from kinmatch.plans.compare import Comparison, compare_listings
from kinmatch.sources import connectors, nested

SITES = ["alpha", "beta", "gamma"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def aliases() -> Aliases:
    return Aliases.load()


def _name(seed: str, value: Column) -> Column:
    """Two made-up words of letters."""
    digest = F.translate(F.md5(F.concat(F.lit(seed), value.cast("string"))), "0123456789abcdef", "bcdfgklmnprstvae")
    return F.concat(F.initcap(F.substring(digest, 1, 6)), F.lit(" "), F.initcap(F.substring(digest, 7, 7)))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a fixture on three sites, with what linking has to deal with.

    Site beta adds affixes and shifts some times by minutes, some by a day; site gamma shifts times,
    writes capitals and swaps some teams. Some rows are missing, some stand on alpha alone; some
    have a team that each site spells in another way, some only words that many teams share.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    e = e.withColumn("home", _name("h", F.col("user_id"))).withColumn("away", _name("a", F.col("event_id") % 997))
    k = F.col("event_id")
    rows = e.withColumn("site_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((k + F.col("site_idx")) % 11 != 0)
    rows = rows.where((F.col("site_idx") == 0) | (k % 29 != 3))
    alpha, beta, gamma = (F.col("site_idx") == i for i in range(3))
    shift = F.when(gamma & (k % 5 == 0), 30).when(beta & (k % 41 == 7), 1440).when(beta & (k % 13 == 0), -15).otherwise(0)
    ts = F.col("ts") + F.make_dt_interval(mins=shift)
    spelled = F.when(alpha, "Man Utd U21").when(beta, "Manchester United U21").otherwise("Man United U21")
    home = F.when(k % 997 == 0, "Sporting United").when(k % 43 == 0, spelled).otherwise(F.col("home"))
    away = F.when(k % 997 == 0, "Real City").otherwise(F.col("away"))
    home = F.when(beta & (k % 3 == 0), F.concat(home, F.lit(" FC"))).when(gamma & (k % 4 == 0), F.upper(home)).otherwise(home)
    away = F.when(gamma & (k % 3 == 1), F.concat(F.lit("AS "), away)).otherwise(away)
    swapped = gamma & (k % 37 == 5)
    home, away = F.when(swapped, away).otherwise(home), F.when(swapped, home).otherwise(away)
    sport = F.element_at(F.array(*(F.lit(s) for s in ("FUTBOL", "BASKETBOL", "VOLEYBOL", "TENIS", "HENTBOL"))), (k % 5 + 1).cast("int"))
    league = F.concat(F.element_at(F.array(*(F.lit(s) for s in ("England", "Spain", "Italy"))), (k % 3 + 1).cast("int")), F.lit(" - "), F.when(beta, F.lit("League ")).otherwise(F.lit("")), F.col("event_type"))
    return rows.select(
        F.element_at(F.array(*map(F.lit, SITES)), F.col("site_idx") + 1).alias("site"), "site_idx", F.col("event_id").alias("row_id"), sport.alias("sport"),
        F.regexp_replace(league, "^.* - ", "").alias("league"), league.alias("league_raw"), F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm").alias("time"),
        timeutil.epoch_ms(F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm")).alias("epoch_ms"), home.alias("home"), away.alias("away"), F.concat(F.lit("e"), k.cast("string")).alias("event_id"),
    )


_compared: dict[tuple[str, str], Comparison] = {}


def comparison(spark: SparkSession, sf_dir: str) -> Comparison:
    """One comparison for all queries of a session: its parts are saved, not collected."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _compared:
        _compared.clear()
        _compared[key] = compare_listings(listings(spark, sf_dir), SITES, aliases())
    return _compared[key]


# -- names ----------------------------------------------------------------------------------------


def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat_ws("", F.lit("  É. "), "p_name", F.lit(" & Co.-"), "p_type").alias("name")).union(table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("'s İŞ"))))
    return names.distinct().select("name", T.fold(F.col("name")).alias("folded"), T.fold_label(F.col("name")).alias("label"))


def text_fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", F.lit("f c"), "p_name", F.lit("fc prag"), F.lower("p_brand"))
    folded = T.fold(name)
    parts = T.tokens(T.merge_initials(folded))
    return table(spark, sf_dir, "part").select("p_partkey", T.joined(parts).alias("merged"), T.joined(T.strip_generic(parts)).alias("stripped"), T.joined(F.transform(parts, T.fold_exonym)).alias("exonyms"), S.token_sort(folded).alias("sorted"))


def text_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.lit("2026/2027"), F.lit("1999"), F.col("p_size").cast("string"), F.lit("2026-27"))
    return table(spark, sf_dir, "part").select("p_partkey", T.league_name(name).alias("league_name"))


def team_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*(F.lit(s) for s in ("", " U21", " (W)", " B", " Reserves", " Women II"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat("p_name", suffix)
    split = T.split_qualifiers(T.fold(name), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", split["core"].alias("core"), F.array_join(split["quals"], ",").alias("quals"), F.array_join(T.match_qualifiers(name, F.lit("Rival Academy")), ",").alias("match_quals"))


def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = listings(spark, sf_dir).select(F.explode(F.array("home", "away")).alias("name"), "sport").distinct()
    return names.select("name", "sport", aliases().normalize_team(F.col("name"), F.col("sport")).alias("normalized"))


def team_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = ("Man Utd U21", "PSG", "B. Dortmund", "Nobody", "La Guaira", "Hollanda")
    name = F.element_at(F.array(*map(F.lit, spelled)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", aliases().resolve_team(name).alias("team_id"))


def league_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("England - EPL", "Turkey - Super Lig", "Europe - UEFA Champions League - League Stage", "Brazil - Serie A", "NATION - Serie A, Women", "Bundesliga")
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("FUTBOL").alias("sport"), key.alias("key"))
    rows = aliases().with_league(rows, "sport", "key", "i")
    return rows.select("c_custkey", "i.name", "i.country", "i.is_region", "i.country_known", "i.core", F.array_join("i.quals", ",").alias("quals"), "i.canonical_id", "i.canonical_confident")


def sport_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("Football", "IceHockey", "RugbyUnion", "Formula1", "chess", "Quidditch"))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(label.alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", "n", sport_of(F.col("label")).alias("sport"), canonical_sport(F.col("label")).alias("canonical"), sport_rank(canonical_sport(F.col("label"))).alias("rank"))


# -- similarity -----------------------------------------------------------------------------------


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of the distinct part names (their number is that of the vocabulary, 64)."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("a")).distinct()
    return names.join(F.broadcast(names.withColumnRenamed("a", "b")), on=None, how="cross")


def similarity_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", F.levenshtein(a, b).cast("bigint").alias("distance"), F.round(S.char_ratio(a, b), 6).alias("ratio"), F.round(S.char_ratio(S.token_sort(a), S.token_sort(b)), 6).alias("sorted_ratio"))


def similarity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    short = F.concat(F.substring(b, 1, 1), F.lit(" "), F.element_at(F.split(b, " "), -1))
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.token_overlap(a, short), 6).alias("overlap"), S.acronym(F.concat_ws("", F.transform(F.split(a, " "), lambda t: F.left(t, F.lit(1)))), b).alias("acronym"))


def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.similarity(F.col("a"), F.col("b")), 6).alias("score")).where("score >= 60")


# -- time -----------------------------------------------------------------------------------------


def time_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm")
    bad = F.when(F.col("event_id") % 7 == 0, F.lit("25:00")).otherwise(time)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(timeutil.epoch_ms(date, bad), F.lit(-1)).alias("epoch_ms"), timeutil.date_ms(date).alias("date_ms"), timeutil.shifted_day(date, 1).alias("next_day"), timeutil.shifted_day(date, -1).alias("day_before"))


def time_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31"))
    return table(spark, sf_dir, "orders").select("o_orderkey", timeutil.date_ms(date).alias("date_ms"))


def time_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 4000).cast("int"))
    day, clock = lambda t: F.date_format(t, "yyyy-MM-dd"), lambda t: F.date_format(t, "HH:mm")
    c = timeutil.compare_times(day("ts"), timeutil.epoch_ms(day("ts"), clock("ts")), day(other), F.when(F.col("event_id") % 9 > 0, timeutil.epoch_ms(day(other), clock(other))), 5)
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", "c.*")


def time_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 10 > 0, F.unix_millis(F.col("ts").cast("timestamp")))
    local, written = timeutil.local_from_ms(ms), timeutil.parse_local(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", local["date"].alias("local_date"), local["time"].alias("local_time"), written["date"].alias("written_date"), written["time"].alias("written_time"))


# -- collecting -----------------------------------------------------------------------------------


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("event_type").alias("sport"), F.when(k % 17 == 0, "").otherwise((k % 700).cast("string")).alias("event_id"), (k % 9).cast("string").alias("league_id"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("L"), (k % 4).cast("string"))).alias("league_name"), F.when(k % 3 == 0, "").otherwise("Land").alias("country_name"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm").alias("time"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("home"),
        F.when(k % 23 == 0, " ").otherwise("rest").alias("away"), k.alias("arrival"),
    )


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.collect_events(_fetched(spark, sf_dir), "arrival", first="2024-01-03", last="2024-01-20")


def collect_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(spark, sf_dir).select("arrival", "state", "league_key")


def collect_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.counters(_collected(spark, sf_dir))


def collect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.summary(_collected(spark, sf_dir).where("state = 'added'"))


def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added events, nested by sport, league and day, and read back from those."""
    tree = collect.nested(_collected(spark, sf_dir).where("state = 'added'"))
    rows = tree.select("sport", F.explode("leagues").alias("l")).select("sport", "l.league", F.explode("l.dates").alias("d")).select("sport", "league", "d.date", F.posexplode("d.matches").alias("at", "m"))
    return rows.select("sport", "league", "date", "at", F.col("m.event_id").alias("event_id"), F.col("m.home").alias("home"), F.col("m.time").alias("time"))


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one day's events each, scanned level by level."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    match = F.struct(F.col("event_id").cast("string").alias("eventId"), F.lit("1").alias("leagueId"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("home"), F.lit("x").alias("away"), F.date_format("ts", "HH:mm").alias("time"))
    days = e.groupBy("day", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", match.alias("m")))).alias("ms"))
    body = F.create_map(F.concat(F.lit("Land - "), "event_type"), F.create_map("day", F.transform("ms", lambda x: x["m"])))
    docs = days.select(F.concat_ws("_", "day", "event_type").alias("site"), (F.dense_rank().over(matching.Window.orderBy("day", "event_type")) - 1).alias("site_idx"), F.to_json(F.create_map(F.lit("Football"), body, F.lit("broken"), F.lit(None).cast("map<string,map<string,array<struct<eventId:string,leagueId:string,home:string,away:string,time:string>>>>"))).alias("document"))
    return nested.parse_documents(docs).select("site", "row_id", "sport", "league", "date", "time", "epoch_ms", "home", "event_id")


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    changes = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"))
    return collect.upsert(stored, changes, "s_suppkey")


def replace_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("site"), "c_custkey")
    return collect.replace_sites(rows, rows.where("site in ('MACHINERY', 'BUILDING') and c_custkey % 2 = 0"))


# -- linkage --------------------------------------------------------------------------------------


def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.with_features(listings(spark, sf_dir), aliases())
    return matching.candidate_pairs(rows).select("a", "b", "day_offset", "prefix_pos")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.score_candidates(listings(spark, sf_dir), aliases())
    return out.select("a", "b", F.round("team_score", 6).alias("team_score"), F.round("league_score", 6).alias("league_score"), "flipped", F.round("confidence", 6).alias("confidence"), "decision", "reason")


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).pairs.select("a", "b", "site_a", "site_b", "team_score", "league_score", "confidence", "decision", "flipped", "diff_minutes", "cross_date", "is_different")


def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two sites, the rows of each that have no pair on the other."""
    c = comparison(spark, sf_dir)
    out = None
    for a in range(len(SITES)):
        for b in range(a + 1, len(SITES)):
            for side, other in zip(matching.unmatched(c.rows, c.pairs, a, b), (b, a), strict=True):
                rows = side.select("site", F.lit(SITES[other]).alias("other"), "row_id", "home", "away")
                out = rows if out is None else out.unionByName(rows)
    return out


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).clusters


def report_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = comparison(spark, sf_dir).discrepancies()
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("sport", "league", "date", "home", "away", pairs("times").alias("times"), pairs("dates").alias("dates"), "date_differs", "max_diff_minutes", F.to_json("deviating_sites").alias("deviating"), F.array_join("missing_sites", ",").alias("missing"), pairs("leagues").alias("leagues"), pairs("teams").alias("teams"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).summary()


def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).coverage()


def report_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).per_site()


def report_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).pair_counts()


def report_single_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).single_site()


def cluster_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of clusters on groups that are known: each event's rows on the sites."""
    rows = listings(spark, sf_dir).withColumn("rid", F.shiftleft(F.col("site_idx").cast("bigint"), 48) + F.col("row_id"))
    own = rows.select("rid", F.col("row_id").alias("cluster_id"))
    a = report.analyse(rows, own, len(SITES))
    return a.select("cluster_id", F.array_join("present", ",").alias("present"), "max_diff", F.array_join(F.transform("deviating", lambda d: F.concat_ws(":", d["site"], d["minutes"].cast("string"))), ",").alias("deviating"), "n_missing", "comparable", "is_different")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(T.fold(F.concat_ws(" ", "p_name", "p_brand")).alias("normalized"))
    pool = table(spark, sf_dir, "part").select(F.lower("p_name").alias("canonical")).distinct().select("canonical", F.concat("canonical", F.lit(" brand")).alias("pool_normalized"), F.col("canonical").alias("pool_order"))
    return suggest.suggestions(names, pool, matching.Options(suggestion_threshold=75))


def unresolved_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    out = suggest.unresolved(suggest.team_names(rows), "team", aliases().normalize_team(F.col("team"), F.col("sport")), "row_id")
    return out.select("source", "sport", "normalized", "records", "type")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in Turkish order with numbers by value."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Ş"), F.col("s_suppkey").cast("string")).alias("name"))
    return rows.withColumn("place", F.row_number().over(matching.Window.orderBy(report.turkish(F.col("name")))).cast("bigint"))


# -- pages ----------------------------------------------------------------------------------------


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.strip_tags(F.col("html"))).alias("text_md5"), H.decode_entities(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(<a\\b[^>]*>)"), F.lit(1))).alias("at", "tag"))
    return tags.select("page_id", "at", H.attributes(F.col("tag"))["href"].alias("href"))


# -- sources: payloads of the three kinds of sites, made of events ----------------------------------

_MENU = '<div><I class="b-check sport" id="check__1" layout="LC"></I><span class="sport-name">Football</span><i class="b-check stage" id="check__11"></i></div>'
_ROW = ("sport", "event_id", "league_key", "date", "time", "home", "away", "state")
#: Events of one type to an answer at most, about: sites bound their answers (`connectors.LONGEST`), and a task holds whole ones.
_ANSWER_IDS = 20_000


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _answer(event_id: Column) -> Column:
    return F.floor(event_id / _ANSWER_IDS).alias("answer")


def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu and pages of one site, every event twice in its page, half of them of another sport."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    event = F.struct(_text(k).alias("mid"), _text(k % 9).alias("lid"), _text(k % 2 + 1).alias("sport_id"), F.concat(F.lit("h"), _text("user_id"), F.lit(" - a - "), _text(k)).alias("event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_start_time"), F.concat(F.lit('L"'), _text(k % 4)).alias("league_name"), F.lit("A & B").alias("country_name"))
    mark = F.concat(F.lit('<a rev="'), F.replace(F.replace(F.to_json(event), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"></a>'))
    pages = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(mark, mark))), "\n").alias("payload"))
    captured = pages.select(F.lit("events").alias("kind"), F.lit("1").alias("sport_no"), "payload").unionByName(spark.createDataFrame([("menu", None, _MENU)], "kind string, sport_no string, payload string"))
    return connectors.site_events("html", captured).select(*_ROW)


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a tree source: answers for each type of event and range of ids, their competitions and games."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    game = F.struct(_text(k).alias("id"), F.concat(F.lit("h"), _text("user_id")).alias("team1_name"), F.concat(F.lit("a"), _text(k)).alias("team2_name"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_ts"), F.when(k % 7 == 0, "OUTRIGHT").alias("show_type"), (k % 3).cast("int").alias("type"), F.when(k % 5 == 0, 1).alias("visible_in_prematch"))
    named = lambda key, value: F.map_from_entries(F.collect_list(F.struct(_text(key), value)))
    games = e.withColumn("c", k % 9).groupBy("event_type", _answer(k), "c").agg(named(k, game).alias("game"))
    competitions = games.groupBy("event_type", "answer").agg(named("c", F.struct(_text("c").alias("id"), F.concat(F.lit("C"), _text("c")).alias("name"), "game")).alias("competition"))
    region = F.create_map(F.lit("1"), F.struct(F.lit("1").alias("id"), F.col("event_type").alias("name"), "competition"))
    tree = F.struct(F.create_map(F.lit("1"), F.struct(F.lit("1").alias("id"), F.lit("Football").alias("name"), region.alias("region"))).alias("sport"))
    return connectors.site_events("tree", competitions.select(F.lit("games").alias("kind"), F.lit("FUTBOL").alias("sport"), F.to_json(tree).alias("payload"))).select(*_ROW)


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk answers of typed records, for each type of event and range of ids; one of three sports is virtual and not asked for."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    record = F.struct(
        F.when(k % 10 == 0, "ODDS").otherwise("MATCH").alias("_type"), _text(k).alias("id"), _text(k % 3 + 1).alias("sportId"), _text(k % 7).alias("parentId"), F.unix_millis(F.col("ts").cast("timestamp")).alias("startTime"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("S"), _text(k % 7))).alias("shortParentName"), F.concat(F.lit("P"), _text(k % 7)).alias("parentName"), F.when(k % 5 > 0, "Venue").alias("venueName"), F.lit("Land").alias("categoryName"),
        F.concat(F.lit("h"), _text("user_id")).alias("homeParticipantName"), F.concat(F.lit("a"), _text(k)).alias("awayParticipantName"),
    )
    bulk = e.groupBy("event_type", _answer(k)).agg(F.to_json(F.collect_list(record)).alias("payload")).select(F.lit("matches").alias("kind"), "payload")
    sports = '[{"_type":"SPORT","id":"1","name":"Football","numberOfUpcomingMatches":5},{"_type":"SPORT","id":"2","name":"Tennis","isVirtual":true,"numberOfUpcomingMatches":9},{"_type":"SPORT","id":"3","name":"Basketball","numberOfUpcomingMatches":1}]'
    return connectors.site_events("records", bulk.unionByName(spark.createDataFrame([("sports", sports)], "kind string, payload string"))).select(*_ROW)


def helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", misc.is_address(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("is_address"))
    return rows.withColumn("third", misc.fixed(F.col("page_id") / 3)).withColumn("last", F.element_at(misc.span(F.lit(1), (F.col("page_id") % 5 + 1).cast("int")), -1))


QUERIES = {
    f.__name__: f
    for f in (
        text_fold, text_fold_documents, text_tokens, text_season, team_qualifiers, team_names, team_resolution, league_resolution, sport_catalog,
        similarity_chars, similarity_tokens, similarity_ratio, time_epochs, time_rollover, time_compare, time_local,
        collect_states, collect_counters, collect_summary, nested_round_trip, json_scan, upsert_rows, replace_sites,
        blocking_pairs, scored_pairs, matched_pairs, unmatched_rows, clusters, report_discrepancies, report_summary, report_coverage,
        report_sites, report_pair_counts, report_single_site, cluster_times, suggestions, unresolved_teams, report_order, html_text, html_links,
        source_html, source_tree, source_records, helpers,
    )
}
