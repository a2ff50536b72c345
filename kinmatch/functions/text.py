"""Folding, tokens and qualifiers of names, as Catalyst columns.

null and "" are alike: every function gives "" (or an empty array) for null.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.resources import words as W

_MARKS = "[\\u0300-\\u036F]"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lookup(pairs: Mapping[str, str], key: Column) -> Column:
    """The value of a small constant map, null if there is none."""
    if not pairs:
        return F.lit(None).cast("string")
    # One literal after constant folding, and one expression before it.
    return F.try_element_at(F.from_json(F.lit(json.dumps(dict(pairs))), "map<string,string>"), key)


def one_of(values: Iterable[str], c: Column) -> Column:
    values = list(values)
    return c.isin(*values) if values else F.lit(False)


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of characters, marks dropped: one to one, and one to several."""
    single, to, several = [], [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000 or 0x300 <= code <= 0x36F:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)
        if plain == char or not any(c.isascii() and c.isalnum() for c in plain):
            continue
        if len(plain) == 1:
            single.append(char)
            to.append(plain)
        else:
            several[char] = plain
    return "".join(single) + "ı", "".join(to) + "i", several


def decomposed(c: Column) -> Column:
    """Characters as their compatibility decomposition without combining marks."""
    single, to, several = _compatible()
    once = F.regexp_replace(F.translate(c, single, to), _MARKS, "")
    # What is not ASCII even so, character by character, and the runs between.
    parts = F.regexp_extract_all(once, F.lit("([^\\x00-\\x7F]|[\\x00-\\x7F]+)"), F.lit(1))
    each = F.transform(parts, lambda x: F.when(F.length(x) == 1, F.coalesce(lookup(several, x), x)).otherwise(x))
    wide = lambda t: t.rlike("[^\\x00-\\x7F]")
    return F.when(~wide(c), c).when(wide(once), F.array_join(each, "")).otherwise(once)


def fold(c: Column) -> Column:
    """Lower case, without accents; everything but a-z and 0-9 is one space, an ampersand nothing."""
    plain = decomposed(F.lower(blank(c)))
    # Full-width capitals and the like only appear by decomposition and are not letters of a name.
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit("")), "[^a-z0-9]+", " "))


def fold_label(c: Column) -> Column:
    """As fold, for names of sports: camel case and digits are split off, an ampersand is a space."""
    spaced = F.regexp_replace(F.regexp_replace(blank(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.trim(F.regexp_replace(decomposed(F.lower(spaced)), "[^a-z0-9]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(blank(folded), " "), lambda t: t != "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def strip_season(c: Column) -> Column:
    return F.regexp_replace(blank(c), "\\b(19|20)\\d{2}([/-](19|20)?\\d{2})?\\b", " ")


def fold_exonym(token: Column) -> Column:
    return F.coalesce(lookup(W.EXONYMS, token), token)


def _unplural(token: Column) -> Column:
    return F.regexp_replace(token, "s$", "")


def normalize_qualifier(token: Column) -> Column:
    return F.coalesce(lookup(W.QUALIFIER_SPELLINGS, token), token)


def qualifier_class(token: Column) -> Column:
    return F.coalesce(lookup(W.LEAGUE_QUALIFIER_CLASSES, token), token)


def as_set(items: Column) -> Column:
    """Sorted and distinct, so that equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(items))


def has_single(parts: Column) -> Column:
    return F.exists(parts, lambda t: F.length(t) == 1)


def split_qualifiers(folded: Column, initials: Column) -> Column:
    """struct<core, quals>: the name without its qualifiers, and those, sorted.

    A last token of one letter is a qualifier too (w: women), unless single letters are initials.
    """
    parts = tokens(folded)
    last = F.size(parts) - 1
    letter = lambda t, i: ~initials & (i == last) & (F.length(t) == 1) & (last > 0)
    marked = F.transform(
        parts,
        lambda t, i: F.struct(
            t.alias("t"),
            F.when(one_of(W.TEAM_QUALIFIERS, t), normalize_qualifier(t)).when(letter(t, i), F.when(t == "w", F.lit("women")).otherwise(t)).alias("q"),
        ),
    )
    core = joined(F.transform(F.filter(marked, lambda m: m["q"].isNull()), lambda m: m["t"]))
    quals = F.transform(F.filter(marked, lambda m: m["q"].isNotNull()), lambda m: m["q"])
    return F.struct(F.when(core != "", core).otherwise(folded).alias("core"), as_set(quals).alias("quals"))


def strip_generic(parts: Column) -> Column:
    return F.filter(parts, lambda t: ~one_of(W.GENERIC_TOKENS, t))


def merge_initials(folded: Column) -> Column:
    """Runs of single-character tokens as one token."""
    return F.regexp_replace(folded, "(?<=\\b\\w) (?=\\w\\b)", "")


def uppercase_tokens(raw: Column) -> Column:
    """Tokens of two letters or more that the raw name has all in capitals, in lower case."""
    parts = F.split(blank(raw), "[\\s.,'’`-]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda t: (F.length(t) >= 2) & (t == F.upper(t)) & t.rlike("[A-Z]")), F.lower))


def name_qualifiers(name: Column) -> Column:
    """The qualifiers that a team's name states, in order; a last w is women."""
    parts = tokens(fold(name))
    last = F.size(parts) - 1
    found = F.transform(parts, lambda t, i: F.when(one_of(W.TEAM_QUALIFIERS, t), normalize_qualifier(t)).when((t == "w") & (i == last) & (last > 0), F.lit("women")))
    return F.filter(found, lambda q: q.isNotNull())


def match_qualifiers(home: Column, away: Column) -> Column:
    """The qualifiers that either team's name states."""
    return as_set(F.concat(name_qualifiers(home), name_qualifiers(away)))


def strong_tokens(folded: Column) -> Column:
    return F.filter(tokens(folded), lambda t: ~one_of(W.WEAK_TOKENS, t))


def beginnings(folded: Column, length: int = 3) -> Column:
    """The beginnings of a name's strong tokens, in order."""
    return F.transform(strong_tokens(folded), lambda t: F.substring(t, 1, length))


def blocking_signature(home_n: Column, away_n: Column, length: int = 3) -> Column:
    """The distinct beginnings of both names' strong tokens, in order."""
    return F.array_distinct(F.concat(beginnings(home_n, length), beginnings(away_n, length)))


def league_name(name: Column) -> Column:
    return fold(strip_season(name))


def split_league_qualifiers(folded: Column) -> Column:
    """struct<core, quals> of a folded league name; words of its stage are dropped."""
    parts = tokens(folded)
    quals = F.transform(F.filter(parts, lambda t: one_of(W.LEAGUE_QUALIFIERS, t)), lambda t: F.coalesce(lookup(W.LEAGUE_QUALIFIER_SPELLINGS, _unplural(t)), _unplural(t)))
    core = joined(F.filter(parts, lambda t: ~one_of([*W.LEAGUE_QUALIFIERS, *W.STAGE_NOISE], t)))
    return F.struct(F.when(core != "", core).otherwise(folded).alias("core"), as_set(quals).alias("quals"))
