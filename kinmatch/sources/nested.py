"""Nested JSON documents of sources: sport -> "Country - League" -> date -> matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.functions import timeutil
from kinmatch.operators.aliases import canonical_sport
from kinmatch.resources import catalog

MATCH = "array<struct<eventId:string,leagueId:string,home:string,away:string,time:string>>"


def site_name(path: Column) -> Column:
    """The file's name without folder, .json and a last "match" or "matches"."""
    base = F.regexp_extract(path, "([^/\\\\]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(base, "(?i)\\.json$", ""), "(?i)[-_]?match(es)?$", "")
    return F.when(plain != "", plain).otherwise(base)


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """position, path, site (made unique by a number) and the text of each file."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    order = F.coalesce(*(F.when(F.col("path").endswith(F.lit(p)), F.lit(i)) for i, p in enumerate(paths)), F.lit(len(paths)))
    named = files.withColumn("position", order).withColumn("name", site_name(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("position", "path"))
    site = F.when(nth == 1, F.col("name")).otherwise(F.concat_ws("_", "name", nth.cast("string")))
    return named.withColumn("site", site).select("position", "path", "site", "document")


def _entries(rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of a JSON object; of equal keys the last counts; what is no object has none."""
    keep = [c for c in rows.columns if c != column]
    # A JSON object that is not one parses to null, and only that node is left out.
    parsed = F.from_json(F.col(column), "map<string,string>")
    keys = F.map_keys(parsed)
    out = rows.select(*keep, keys.alias("_keys"), F.posexplode(parsed).alias("_at", key, value))
    return out.where(~F.array_contains(F.slice("_keys", F.col("_at") + 2, F.greatest(F.size("_keys"), F.lit(1))), F.col(key))).drop("_keys")


def recognised(document: Column) -> Column:
    """Whether a document is an object with a sport of the catalog among its keys."""
    keys = F.map_keys(F.from_json(document, "map<string,string>"))
    known = [k for k, _, _ in catalog.SPORTS]
    return F.coalesce(F.exists(keys, lambda k: canonical_sport(k).isin(*known)), F.lit(False))


def parse_documents(documents: DataFrame, offset_minutes: int = timeutil.OFFSET_MINUTES) -> DataFrame:
    """Listings of documents (site, site_idx, document), in the documents' order.

    Levels are parsed one by one, so that a node of the wrong type is left out alone.
    """
    sports = _entries(documents.select("site", "site_idx", "document"), "document", "sport_raw", "leagues").withColumnRenamed("_at", "at_sport")
    leagues = _entries(sports, "leagues", "league_raw", "dates").withColumnRenamed("_at", "at_league")
    dates = _entries(leagues, "dates", "date", "matches").withColumnRenamed("_at", "at_date")
    rows = dates.where(F.trim("matches").startswith("[")).withColumn("parsed", F.from_json("matches", MATCH))
    rows = rows.select("site", "site_idx", "sport_raw", "league_raw", "date", "at_sport", "at_league", "at_date", F.posexplode("parsed").alias("at", "m")).where("m is not null")
    order = Window.partitionBy("site_idx").orderBy("at_sport", "at_league", "at_date", "at")
    name = F.when(F.locate(" - ", F.col("league_raw")) > 0, F.trim(F.expr("substr(league_raw, locate(' - ', league_raw) + 3)"))).otherwise(F.trim("league_raw"))
    return rows.select(
        "site", "site_idx", (F.row_number().over(order) - 1).cast("bigint").alias("row_id"), canonical_sport(F.col("sport_raw")).alias("sport"), name.alias("league"), "league_raw",
        "date", F.col("m.time").alias("time"), timeutil.epoch_ms(F.col("date"), F.col("m.time"), offset_minutes).alias("epoch_ms"),
        F.col("m.home").alias("home"), F.col("m.away").alias("away"), F.col("m.eventId").alias("event_id"),
    )


def write_document(document: DataFrame, path: str) -> bool:
    """The document's text as a folder of one file; an empty result overwrites nothing."""
    text = document.where("document is not null and document <> '{}'")
    if text.isEmpty():
        return False
    text.select("document").coalesce(1).write.mode("overwrite").text(path)
    return True
