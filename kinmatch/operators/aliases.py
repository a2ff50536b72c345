"""Alias tables: spellings that stand for one team, country or league.

Tables are small constants of the plan (their size is that of the alias file), so resolving is a
projection without a join.
"""

from __future__ import annotations

import json
import logging
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.resources import catalog
from kinmatch.resources import words as W

log = logging.getLogger(__name__)
DEFAULT_FILE = Path(__file__).parent.parent / "resources" / "aliases.json"


def fold_value(s: str | None) -> str:
    """T.fold of one value."""
    plain = unicodedata.normalize("NFKD", (s or "").lower().replace("ı", "i"))
    return re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]|&", "", plain)).strip()


def label_value(s: str | None) -> str:
    """T.fold_label of one value."""
    spaced = re.sub("([A-Za-z])([0-9])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", s or ""))
    plain = unicodedata.normalize("NFKD", spaced.lower().replace("ı", "i"))
    return re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", plain)).strip()


def sport_by_key(key: str) -> tuple[str, str, tuple[str, ...]] | None:
    """The catalog's row of a key."""
    return next((row for row in catalog.SPORTS if row[0] == key), None)


def sport_by_id(id_: str | int) -> tuple[str, str, tuple[str, ...]] | None:
    """The catalog's row of an id."""
    return next((row for row in catalog.SPORTS if str(row[1]) == str(id_)), None)


@lru_cache(maxsize=1)
def sport_labels() -> dict[str, str]:
    return {label_value(x): key for key, id_, names in catalog.SPORTS for x in (*names, key, id_)}


def sport_of(*names: Column) -> Column:
    """The catalog's key for the first name that it knows."""
    return F.coalesce(*(T.lookup(sport_labels(), T.fold_label(n)) for n in names))


def canonical_sport(name: Column) -> Column:
    """The catalog's key, or the name in capitals, or the unknown sport."""
    return F.coalesce(sport_of(name), F.when(T.blank(name) != "", F.upper(name)), F.lit(catalog.UNKNOWN_SPORT))


def sport_rank(key: Column) -> Column:
    order = {k: str(i) for i, (k, _, _) in enumerate(catalog.SPORTS)}
    return F.coalesce(T.lookup(order, key).cast("int"), F.lit(len(order)))


def enabled_sports(listed: str | None) -> list[str] | None:
    """Keys of a list parted by commas or spaces; None, for all, if it names no sport."""
    keys = dict.fromkeys(k for part in re.split(r"[,\s]+", listed or "") if (k := sport_labels().get(label_value(part))))
    return list(keys) or None


@dataclass
class Aliases:
    """Folded spellings and what they stand for. The first record keeps a spelling that two claim."""

    team_ids: dict[str, str] = field(default_factory=dict)
    team_names: dict[str, str] = field(default_factory=dict)  # id -> canonical
    countries: dict[str, str] = field(default_factory=dict)
    regions: list[str] = field(default_factory=list)
    leagues: dict[str, str] = field(default_factory=dict)  # sport|country|name -> id
    league_names: dict[str, str] = field(default_factory=dict)  # id -> canonical
    #: sport|name -> id and country, only of names that one spelling gives.
    league_alone: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    known_aliases: dict[str, str] = field(default_factory=dict)  # folded alias -> folded canonical

    @classmethod
    def load(cls, path: str | Path | None = None) -> Aliases:
        """From a file of the shape of the default one; an unreadable file gives empty tables and a warning."""
        try:
            data = json.loads(Path(path or DEFAULT_FILE).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            log.warning("no aliases from %s: %s", path, e)
            data = {}
        out = cls()
        for id_, entry in _records(data.get("teams")):
            name = entry.get("canonical", id_)
            out.team_names[id_] = name
            for alias in entry.get("aliases", []):
                out.known_aliases[fold_value(alias)] = fold_value(name)
            for key in filter(None, map(fold_value, _spellings(name, entry))):
                if out.team_ids.setdefault(key, id_) != id_:
                    log.warning("%r stands for %s and %s", key, out.team_ids[key], id_)
        for name, spellings in (data.get("countries") or {}).items():
            out.countries |= {key: name for s in (name, *spellings) if (key := fold_value(s))}
        out.regions = list(filter(None, map(fold_value, data.get("regions") or [])))
        alone: dict[str, list[tuple[str, str | None]]] = {}
        for id_, entry in _records(data.get("leagues")):
            sport, country = sport_labels().get(label_value(entry.get("sport"))), entry.get("country")
            name = out.league_names[id_] = entry.get("canonical", id_)
            # Each spelling counts, so two that fold alike are not "the only one".
            for key in filter(None, map(fold_value, _spellings(name, entry))):
                out.leagues.setdefault(f"{sport or '*'}|{fold_value(country) or '*'}|{key}", id_)
                alone.setdefault(f"{sport or '*'}|{key}", []).append((id_, country))
        out.league_alone = {k: v[0] for k, v in alone.items() if len(v) == 1}
        return out

    def stats(self) -> dict[str, int]:
        return {
            "teams": len(self.team_names), "team_aliases": len(self.team_ids), "countries": len(self.countries), "regions": len(self.regions),
            "leagues": len(self.league_names), "league_aliases": len(self.leagues), "leagues_by_name_alone": len(self.league_alone), "known_aliases": len(self.known_aliases),
        }

    def team_by_id(self, id_: str) -> str | None:
        """A team's canonical name."""
        return self.team_names.get(id_)

    def known_alias(self, folded: Column) -> Column:
        """The folded canonical name of a folded alias."""
        return T.lookup(self.known_aliases, folded)

    # -- teams --

    def team_id(self, folded: Column) -> Column:
        return T.lookup(self.team_ids, folded)

    def normalize_team(self, name: Column, sport: Column | None = None, folded: Column | None = None) -> Column:
        """Folded, as its canonical name if it is an alias; initials merged, exonyms and cities as one spelling, affixes gone."""
        folded = T.fold(name) if folded is None else folded
        canonical = {key: fold_value(self.team_names[id_]) for key, id_ in self.team_ids.items()}
        parts = F.transform(T.tokens(T.merge_initials(F.coalesce(T.lookup(canonical, folded), folded))), T.fold_exonym)
        if sport is not None:
            upper = T.uppercase_tokens(name)
            city = lambda t: F.when(F.array_contains(upper, t), T.lookup(W.CITY_ABBREVIATIONS, t))
            expanded = F.flatten(F.transform(parts, lambda t: F.split(F.coalesce(city(t), t), " ")))
            parts = F.when(T.one_of(W.US_LEAGUE_SPORTS, sport), expanded).otherwise(parts)
        stripped = T.strip_generic(parts)
        if sport is not None:
            own = [(key, t) for key, generic in W.SPORT_GENERIC_TOKENS.items() for t in generic]
            pairs = [F.struct(F.lit(key).alias("sport"), F.lit(t).alias("token")) for key, t in own]
            narrowed = F.filter(stripped, lambda t: ~F.struct(sport.alias("sport"), t.alias("token")).isin(*pairs))
            stripped = F.when(T.one_of(W.SPORT_GENERIC_TOKENS, sport) & (F.size(narrowed) > 0), narrowed).otherwise(stripped)
        return T.joined(F.when(F.size(stripped) > 0, stripped).otherwise(parts))

    def resolve_team(self, name: Column, sport: Column | None = None) -> Column:
        """The team's id by its folded name, else by that without qualifiers, else by the normalised one."""
        folded = T.fold(name)
        core = T.split_qualifiers(folded, F.lit(False))["core"]
        return F.coalesce(self.team_id(folded), self.team_id(core), self.team_id(self.normalize_team(name, sport)))

    # -- countries and leagues --

    def resolve_country(self, raw: Column) -> Column:
        """struct<country, is_region, known>: a region is no country; an unknown country is itself."""
        key = T.fold(raw)
        region, known = T.one_of(self.regions, key), T.lookup(self.countries, key)
        country = F.when((key != "") & ~region, F.coalesce(known, F.trim(raw)))
        return F.struct(country.alias("country"), (region & (key != "")).alias("is_region"), (known.isNotNull() & ~region).alias("known"))

    def league_alias(self, sport: Column, country: Column, name: Column) -> Column:
        """struct<id, confident>: by sport, country and name; else by sport and a name that is one league's."""
        place = F.coalesce(F.nullif(T.fold(country), F.lit("")), F.lit("*"))
        exact = T.lookup(self.leagues, F.concat_ws("|", sport, place, name))
        alone = F.concat_ws("|", sport, name)
        other = T.lookup({k: v[0] for k, v in self.league_alone.items()}, alone)
        home = T.lookup({k: v[1] for k, v in self.league_alone.items() if v[1]}, alone)
        fits = country.isNull() | home.isNull() | (home == country)
        return F.struct(F.when(name != "", F.coalesce(exact, F.when(fits, other))).alias("id"), (exact.isNotNull() & (name != "")).alias("confident"))

    def with_league(self, df: DataFrame, sport: str, key: str, out: str = "league_info") -> DataFrame:
        """df with what is known of its "Country - League" keys: a struct as in the listing schema.

        Steps are columns of their own, so that each is worked out once.
        """
        raw = T.blank(F.col(key))
        df = df.withColumn("_at", F.locate(" - ", raw))
        df = df.withColumn("_country_raw", F.when(F.col("_at") > 0, F.trim(F.substr(raw, F.lit(1), F.col("_at") - 1))))
        df = df.withColumn("_name", F.when(F.col("_at") > 0, F.trim(F.substr(raw, F.col("_at") + 3))).otherwise(F.trim(raw)))
        df = df.withColumn("_place", self.resolve_country(F.col("_country_raw"))).withColumn("_folded", T.league_name(F.col("_name")))
        df = df.withColumn("_parts", T.split_league_qualifiers(F.col("_folded")))
        country = F.col("_place.country")
        df = df.withColumn("_core", self.league_alias(F.col(sport), country, F.col("_parts.core"))).withColumn("_whole", self.league_alias(F.col(sport), country, F.col("_folded")))
        hit = F.when(F.col("_core.id").isNotNull(), F.col("_core")).otherwise(F.col("_whole"))
        info = F.struct(
            F.col("_name").alias("name"), F.col("_country_raw").alias("country_raw"), country.alias("country"), F.col("_place.is_region"), F.col("_place.known").alias("country_known"),
            F.col("_folded").alias("folded"), F.col("_parts.core"), F.col("_parts.quals"), hit["id"].alias("canonical_id"), (hit["id"].isNotNull() & hit["confident"]).alias("canonical_confident"),
        )
        return df.withColumn(out, info).drop("_at", "_country_raw", "_name", "_place", "_folded", "_parts", "_core", "_whole")


def _records(entries: dict | None):
    return ((k, v) for k, v in (entries or {}).items() if not k.startswith("_") and isinstance(v, dict))


def _spellings(name: str, entry: dict) -> list[str]:
    return list(dict.fromkeys([name, *entry.get("aliases", []), *(x for xs in (entry.get("sources") or {}).values() for x in xs or [])]))
