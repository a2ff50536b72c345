"""What three kinds of sites answer, as rows: HTML attributes, a JSON tree, typed records.

Each parser takes a column of captured payloads; how they are fetched is in `connectors`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import html as H
from kinmatch.functions import timeutil
from kinmatch.functions.text import blank
from kinmatch.operators.aliases import sport_of


def split_participants(name: Column) -> Column:
    """struct<home, away> at the first " - "; without one all is home."""
    value = F.trim(blank(name))
    at = F.locate(" - ", value)
    return F.struct(F.when(at > 0, F.trim(F.substr(value, F.lit(1), at - 1))).otherwise(value).alias("home"), F.when(at > 0, F.trim(F.substr(value, at + 3))).otherwise("").alias("away"))


# -- HTML -----------------------------------------------------------------------------------------


def parse_menu(pages: DataFrame, html: str = "html") -> DataFrame:
    """sport_no, name, layout, league_ids of menus: markers of leagues belong to the sport's marker before them.

    Each capture is a menu of its own, known by the hash of its text; equal captures are one.
    """
    keys = ["capture", *(c for c in pages.columns if c not in (html, "capture"))]
    if "capture" not in pages.columns:
        pages = pages.withColumn("capture", F.xxhash64(F.col(html))).dropDuplicates(keys)
    tag = "(?i)(<i\\b[^>]*>(?:(?!<i\\b)[\\s\\S])*)"
    parts = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(1))).alias("at", "part"))
    attrs = H.attributes(F.regexp_extract("part", "(?i)^(<i\\b[^>]*>)", 1))
    number = F.regexp_extract(F.coalesce(attrs["id"], F.lit("")), "^check__(\\d+)$", 1)
    classes = F.split(F.coalesce(attrs["class"], F.lit("")), "\\s+")
    kind = F.when(F.array_contains(classes, "b-check") & F.array_contains(classes, "sport"), "sport").when(F.array_contains(classes, "b-check") & F.array_contains(classes, "stage"), "stage")
    name = H.strip_tags(F.regexp_extract("part", "(?i)<span\\b[^>]*class=[\"'][^\"']*\\bsport-name\\b[^\"']*[\"'][^>]*>([\\s\\S]*?)</span>", 1))
    marks = parts.select("*", number.alias("number"), kind.alias("kind"), F.when(name != "", name).otherwise(F.concat(F.lit("SPORT_"), number)).alias("name"), F.coalesce(attrs["layout"], F.lit("")).alias("layout")).where("number <> '' and kind is not null").drop("part")
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scoped = marks.withColumn("scope", F.last(F.when(F.col("kind") == "sport", F.struct("at", "number", "name", "layout")), ignorenulls=True).over(w)).where("scope is not null")
    leagues = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "stage", F.struct("at", "number")))), lambda x: x["number"]))
    return scoped.groupBy(*keys, "scope").agg(leagues.alias("league_ids")).select(*(k for k in keys if k != "capture"), F.col("scope.at").alias("at"), F.col("scope.number").alias("sport_no"), F.col("scope.name").alias("name"), F.col("scope.layout").alias("layout"), "league_ids")


def select_sports(menu: DataFrame, enabled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Menu entries with their sport that can be asked for, and the names that the catalog does not know."""
    known = menu.withColumn("sport", sport_of(F.col("name")))
    wanted = known.where("sport is not null and layout <> '' and size(league_ids) > 0")
    return (wanted.where(F.col("sport").isin(*enabled)) if enabled else wanted), known.where("sport is null").select("name")


EVENT = "struct<mid:string,lid:string,sport_id:string,event:string,event_start_time:string,league_name:string,country_name:string>"


def parse_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """Event records in rev="{json}" attributes, the first of each mid over all captures of the same keys.

    at: the place in all of them, by capture (its name, or else the hash of its text) and position.
    """
    keys = [c for c in pages.columns if c not in (html, "capture")]
    capture = F.xxhash64(F.col("capture")) if "capture" in pages.columns else F.xxhash64(F.col(html))
    pages = pages.select(*keys, capture.alias("capture"), html)
    revs = pages.select(*keys, "capture", F.posexplode(F.regexp_extract_all(F.col(html), F.lit('\\brev="([^"]+)"'), F.lit(1))).alias("at", "rev"))
    text = H.decode_entities(F.col("rev"))
    rows = revs.where(text.startswith("{") & text.endswith("}")).select(*keys, "capture", F.col("at").alias("place"), F.from_json(text, EVENT).alias("e"))
    full = lambda c: blank(F.col(f"e.{c}")) != ""
    rows = rows.where(full("mid") & full("event_start_time") & full("lid"))
    nth = F.row_number().over(Window.partitionBy(*keys, "e.mid").orderBy("capture", "place"))
    at = F.struct("capture", "place").alias("at")
    return rows.withColumn("nth", nth).where("nth = 1").select(*keys, at, "e.*")


def html_events(events: DataFrame, sport_no: Column, sport: Column) -> DataFrame:
    """Rows to collect from the events of the sport that was asked for; times are local as written."""
    teams, when = split_participants(F.col("event")), timeutil.parse_local(F.col("event_start_time"))
    own = events.where(F.col("sport_id") == sport_no)
    return own.select(sport.alias("sport"), F.col("mid").alias("event_id"), F.col("lid").alias("league_id"), "league_name", "country_name", when["date"].alias("date"), when["time"].alias("time"), teams["home"].alias("home"), teams["away"].alias("away"), F.col("at").alias("arrival"))


# -- JSON tree ------------------------------------------------------------------------------------

_GAME = "struct<id:string,team1_name:string,team2_name:string,start_ts:bigint,show_type:string,type:int,is_blocked:int,visible_in_prematch:int>"
_TREE = f"struct<sport:map<string,struct<id:string,name:string,alias:string,region:map<string,struct<id:string,name:string,competition:map<string,struct<id:string,name:string,game:string>>>>>>>"


def competitions(trees: DataFrame, payload: str = "payload") -> DataFrame:
    """sport, region, competition rows of a discovery answer; those without games are left out."""
    sports = trees.select(F.explode(F.map_values(F.from_json(payload, _TREE)["sport"])).alias("s"))
    regions = sports.select("s", F.explode(F.map_values("s.region")).alias("r"))
    rows = regions.select("s", "r", F.explode(F.map_values("r.competition")).alias("c"))
    games = F.coalesce(F.col("c.game").try_cast("int"), F.lit(0))
    return rows.where(games > 0).select(F.col("s.id").alias("sport_no"), F.coalesce("s.alias", "s.name").alias("name"), F.col("r.name").alias("region"), F.col("c.id").alias("competition_id"), F.col("c.name").alias("competition"), games.alias("games"))


def prematch(game: Column) -> Column:
    """The predicate that the tree source is asked with."""
    return F.coalesce(game["visible_in_prematch"] == 1, F.lit(False)) | F.coalesce(game["type"].isin(0, 2), F.lit(False))


def tree_events(trees: DataFrame, sport: Column, payload: str = "payload") -> DataFrame:
    """Rows to collect from a games answer: sport -> region -> competition -> game; outrights are left out."""
    schema = _TREE.replace("game:string", f"game:map<string,{_GAME}>")
    # An answer is hashed once, not for each of its games, and no row carries more of it than its own level.
    rows = trees.select(sport.alias("sport"), F.xxhash64(payload).alias("capture"), F.col(payload).alias("payload"))
    rows = rows.select("sport", "capture", F.explode(F.map_values(F.from_json("payload", schema)["sport"])).alias("s"))
    rows = rows.select("sport", "capture", F.explode(F.map_values("s.region")).alias("r"))
    rows = rows.select("sport", "capture", F.col("r.name").alias("region"), F.explode(F.map_values("r.competition")).alias("c"))
    rows = rows.select("sport", "capture", "region", F.col("c.id").alias("league_id"), F.col("c.name").alias("league_name"), F.posexplode(F.map_values("c.game")).alias("place", "g"))
    rows = rows.where((F.coalesce("g.show_type", F.lit("")) != "OUTRIGHT") & prematch(F.col("g")))
    when = timeutil.local_from_seconds(F.col("g.start_ts"))
    return rows.select("sport", F.col("g.id").alias("event_id"), "league_id", "league_name", F.col("region").alias("country_name"), when["date"].alias("date"), when["time"].alias("time"), F.col("g.team1_name").alias("home"), F.col("g.team2_name").alias("away"), F.struct("capture", "place").alias("arrival"))


# -- typed records --------------------------------------------------------------------------------

RECORD = (
    "array<struct<_type:string,id:string,name:string,shortName:string,isVirtual:boolean,isSimulated:boolean,hasMatches:boolean,numberOfUpcomingMatches:int,parentId:string,sportId:string,startTime:bigint,"
    "shortParentName:string,parentName:string,venueName:string,categoryName:string,homeParticipantName:string,awayParticipantName:string>>"
)


def records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    # Hashed below the explode: beside it, it would be worked out for each record.
    rows = payloads.select(F.xxhash64(payload).alias("capture"), F.col(payload).alias("payload"))
    rows = rows.select("capture", F.posexplode(F.from_json("payload", RECORD)).alias("place", "r"))
    return rows.select(F.struct("capture", "place").alias("at"), "r.*")


def discover_sports(rows: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Sports of the catalog with matches to come, the largest first."""
    real = rows.where((F.col("_type") == "SPORT") & ~F.coalesce("isVirtual", F.lit(False)) & ~F.coalesce("isSimulated", F.lit(False)) & F.coalesce("hasMatches", F.lit(True)) & (F.coalesce("numberOfUpcomingMatches", F.lit(0)) > 0))
    known = real.withColumn("sport", sport_of(F.col("name"), F.col("shortName"))).where("sport is not null")
    known = known.where(F.col("sport").isin(*enabled)) if enabled else known
    return known.select("id", "sport", F.col("numberOfUpcomingMatches").alias("upcoming")).orderBy(F.desc("upcoming"), "id")


def record_events(rows: DataFrame, sport_id: Column, sport: Column) -> DataFrame:
    """Rows to collect from a bulk answer: matches of the sport; short league names and venues come first."""
    first = lambda *names: F.coalesce(*(F.when(blank(F.col(n)) != "", F.col(n)) for n in names))
    when = timeutil.local_from_ms(F.col("startTime"))
    own = rows.where((F.col("_type") == "MATCH") & (F.col("sportId") == sport_id))
    return own.select(sport.alias("sport"), F.col("id").alias("event_id"), F.col("parentId").alias("league_id"), first("shortParentName", "parentName").alias("league_name"), first("venueName", "categoryName").alias("country_name"), when["date"].alias("date"), when["time"].alias("time"), F.col("homeParticipantName").alias("home"), F.col("awayParticipantName").alias("away"), F.col("at").alias("arrival"))
