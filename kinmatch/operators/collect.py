"""From fetched events to the rows of a source: validity, first-wins dedup, filters, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import blank
from kinmatch.resources import catalog


def date_filter(date: Column, dates: list[str] | None = None, first: str | None = None, last: str | None = None) -> Column:
    """Allowed days, or else an inclusive range of them, either end open."""
    if dates:
        return date.isin(*dates)
    keep = F.lit(True)
    keep = keep & (date >= first) if first else keep
    return keep & (date <= last) if last else keep


def league_key(country: Column, league: Column, league_id: Column) -> Column:
    """"country - league", whichever of them there is, the league's number, or the unknown league."""
    name = F.trim(F.when(blank(league) != "", league).when(blank(league_id) != "", F.concat(F.lit("LIG_"), league_id)).otherwise(""))
    place = F.trim(blank(country))
    return F.when((place != "") & (name != ""), F.concat_ws(" - ", place, name)).when(name != "", name).when(place != "", place).otherwise(catalog.UNKNOWN_LEAGUE)


def collect_events(events: DataFrame, arrival: str, dates: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """events with league_key and state: added, duplicate, skipped or filtered.

    events: sport, event_id, league_id, league_name, country_name, date, time, home, away. Of rows
    with a sport and event id the first to arrive is added; rows without an id are never duplicates.
    """
    trimmed = {c: F.trim(blank(F.col(c))) for c in ("home", "away", "date")} | {c: blank(F.col(c)) for c in ("event_id", "league_id", "time")}
    rows = events.withColumns(trimmed).withColumn("league_key", league_key(F.col("country_name"), F.col("league_name"), F.col("league_id")))
    valid = (blank(F.col("sport")) != "") & (F.col("home") != "") & (F.col("away") != "") & (F.col("date") != "")
    state = F.when(~valid, "skipped").when(~date_filter(F.col("date"), dates, first, last), "filtered").otherwise("added")
    rows = rows.withColumn("state", state)
    nth = F.row_number().over(Window.partitionBy("sport", "event_id", "state").orderBy(arrival))
    # Blank ids are spread over arrivals, so that they form no hot group.
    known = rows.where("state = 'added' and event_id <> ''").withColumn("state", F.when(nth > 1, "duplicate").otherwise("added"))
    return known.unionByName(rows.where("not (state = 'added' and event_id <> '')"))


def counters(collected: DataFrame) -> DataFrame:
    return collected.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("added", "duplicate", "skipped", "filtered")))


def nested(added: DataFrame) -> DataFrame:
    """sport, leagues: array<struct<league, dates: array<struct<date, matches>>>>, sorted; the four legacy sports always."""
    order = F.struct("time", F.concat_ws("-", "home", "away").alias("names"), F.struct("event_id", "league_id", "home", "away", "time").alias("match"))
    by_date = added.groupBy("sport", "league_key", "date").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["match"]).alias("matches"))
    by_league = by_date.groupBy("sport", "league_key").agg(F.array_sort(F.collect_list(F.struct("date", "matches"))).alias("dates"))
    # Leagues sort by a Turkish collation: rank first, then collect by rank.
    at = F.row_number().over(Window.partitionBy("sport").orderBy(F.collate("league_key", "tr"), "league_key"))
    leagues = by_league.withColumn("at", at).groupBy("sport").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(F.col("league_key").alias("league"), "dates").alias("x")))), lambda x: x["x"]).alias("leagues"))
    order_of = {k: i for i, (k, _, _) in enumerate(catalog.SPORTS)}
    legacy = added.sparkSession.createDataFrame([(k,) for k in catalog.LEGACY_KEYS], "sport string")
    every = legacy.join(leagues, "sport", "full_outer")
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in order_of.items() for x in (k, v))), "sport"), F.lit(len(order_of)))
    legacy_first = F.when(F.col("sport").isin(*catalog.LEGACY_KEYS), F.array_position(F.array(*map(F.lit, catalog.LEGACY_KEYS)), F.col("sport"))).otherwise(F.lit(99))
    return every.orderBy(legacy_first, rank, "sport")


def document(nested_rows: DataFrame) -> DataFrame:
    """One JSON text, sport -> league -> date -> matches. Its size is that of one source's output."""
    dates = lambda d: F.map_from_entries(F.transform(d, lambda x: F.struct(x["date"], x["matches"])))
    leagues = F.map_from_entries(F.transform(F.coalesce("leagues", F.array().cast(nested_rows.schema["leagues"].dataType)), lambda x: F.struct(x["league"], dates(x["dates"]))))
    return nested_rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("sport", leagues.alias("leagues"))))).alias("document"))


def summary(added: DataFrame) -> DataFrame:
    """Leagues and matches of each sport."""
    return added.groupBy("sport").agg(F.countDistinct("league_key").alias("leagues"), F.count("*").alias("matches"))


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """stored with the rows of changes in place of those with their key, and new ones added.

    Of several changes of a key the last counts, by `order`, a column of changes that is not kept;
    without it the one with the greatest values.
    """
    names = [c for c in changes.columns if c != order]
    last = F.desc(order) if order else F.struct(*(F.col(c) for c in names)).desc()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(last))
    changes = changes.withColumn("_nth", nth).where("_nth = 1").select(*names)
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes)


def replace_sites(stored: DataFrame, fresh: DataFrame, site: str = "site") -> DataFrame:
    """fresh rows instead of a site's stored ones; a site without fresh rows keeps what it has."""
    return stored.join(fresh.select(site).distinct(), site, "left_anti").unionByName(fresh)
