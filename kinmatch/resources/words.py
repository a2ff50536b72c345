"""Word lists of name matching. All are fixed values."""

# fmt: off

TEAM_QUALIFIERS = [
    "ii", "iii", "u16", "u17", "u18", "u19", "u20", "u21", "u23", "res", "reserve", "reserves", "rezerv", "castilla", "atletic", "youth", "junior",
    "juniors", "jr", "genclik", "altyapi", "amateur", "amator", "women", "womens", "wom", "kadin", "kadinlar", "femenino", "feminin", "feminine",
    "fem", "ladies", "academy", "akademi",
]

LEAGUE_QUALIFIERS = [
    "u16", "u17", "u18", "u19", "u20", "u21", "u23", "women", "womens", "wom", "kadin", "kadinlar", "ladies", "femenino", "feminin", "feminine",
    "fem", "youth", "junior", "juniors", "juvenil", "genclik", "reserve", "reserves", "rezerv", "amateur", "amator",
]

#: Class of each league qualifier.
LEAGUE_QUALIFIER_CLASSES = {
    "u16": "youth", "u17": "youth", "u18": "youth", "u19": "youth", "u20": "youth", "u21": "youth", "u23": "youth", "youth": "youth",
    "junior": "youth", "juniors": "youth", "juvenil": "youth", "genclik": "youth", "women": "women", "womens": "women", "wom": "women",
    "kadin": "women", "kadinlar": "women", "ladies": "women", "femenino": "women", "feminin": "women", "feminine": "women", "fem": "women",
    "reserve": "reserve", "reserves": "reserve", "rezerv": "reserve", "amateur": "amateur", "amator": "amateur",
}

#: The one spelling of a team qualifier that has several.
QUALIFIER_SPELLINGS = {
    "womens": "women", "wom": "women", "kadin": "women", "kadinlar": "women", "ladies": "women", "femenino": "women", "feminin": "women",
    "feminine": "women", "fem": "women", "reserves": "reserve", "rezerv": "reserve", "res": "reserve", "ii": "reserve", "juniors": "youth",
    "junior": "youth", "jr": "youth", "genclik": "youth", "altyapi": "youth", "akademi": "academy", "amator": "amateur",
}

WEAK_TOKENS = [
    "united", "utd", "city", "sporting", "racing", "real", "athletic", "atletico", "club", "deportivo", "deportes", "sportif", "sport", "sports",
    "de", "del", "la", "le", "el", "al", "las", "los", "os", "as", "the", "and", "y", "e", "di", "da", "do", "dos", "van", "von",
]

GENERIC_TOKENS = [
    "fc", "cf", "sk", "ac", "sc", "cd", "ud", "if", "bk", "fk", "sv", "vfl", "vfb", "ss", "ca", "ce", "ec", "aa", "cr", "afc", "cfc", "hc", "hk",
    "kh", "mhc", "mhk", "jk", "us", "ssd", "asd", "nk", "rk", "as", "cs", "cp", "rc", "cda", "club", "skp", "ohk", "shk", "bc", "kk", "dvsc",
]

SPORT_GENERIC_TOKENS = {"RAGBI": ["rugby", "rc"], "BUZ_HOKEYI": ["hokej", "hockey"], "BASKETBOL": ["basket", "basketball", "bc"]}

INDIVIDUAL_SPORTS = [
    "TENIS", "MASA_TENISI", "BOKS", "MMA", "SATRANC", "DART", "SNOOKER", "GOLF", "BISIKLET", "SUMO", "KAYAK", "BIATLON",
]

US_LEAGUE_SPORTS = [
    "BASKETBOL", "AMERIKAN_FUTBOLU", "BEYZBOL", "BUZ_HOKEYI",
]

EXONYMS = {
    "munih": "munich", "moskova": "moscow", "sofya": "sofia", "prag": "prague", "praha": "prague", "viyana": "wien", "vien": "wien",
    "atina": "athens", "kopenhag": "copenhagen", "lizbon": "lisbon", "brüksel": "brussels", "bruksel": "brussels", "kiev": "kyiv",
    "belgrad": "belgrade", "bukres": "bucharest", "varsova": "warsaw", "milano": "milan", "roma": "rome", "torino": "turin", "napoli": "naples",
    "saint": "st", "sankt": "st",
}

CITY_ABBREVIATIONS = {
    "ny": "new york", "la": "los angeles", "sa": "san antonio", "sf": "san francisco", "gs": "golden state", "okc": "oklahoma city",
    "no": "new orleans", "kc": "kansas city", "gb": "green bay", "ne": "new england", "tb": "tampa bay", "lv": "las vegas",
}

STAGE_NOISE = [
    "league", "stage", "group", "round", "matchday", "statistics", "phase", "season", "regular", "playoff", "playoffs",
]

#: A plural ending that a league qualifier loses, and the two spellings that then are one.
LEAGUE_QUALIFIER_SPELLINGS = {"kadin": "women", "kadinlar": "women"}
