"""Likeness of folded names, 0 to 100, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.text import joined, one_of, tokens
from kinmatch.resources.words import WEAK_TOKENS


def char_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest) * 100)


def token_sort(a: Column) -> Column:
    return joined(F.array_sort(tokens(a)))


def _abbreviates(x: Column, y: Column) -> Column:
    return (F.length(x) < F.length(y)) & y.startswith(x) | (F.length(y) < F.length(x)) & x.startswith(y)


def _overlap(ta: Column, tb: Column, weight_a: Column, weight_b: Column) -> Column:
    first = F.struct(tb.alias("left"), F.lit(0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        exact = F.array_position(acc["left"], x)
        near = F.array_position(F.transform(acc["left"], lambda y: F.when((y != "") & _abbreviates(x, y), "y").otherwise("n")), "y")
        at = F.when(exact > 0, exact).otherwise(near)
        # A taken token is blanked, so that positions stay.
        left = F.transform(acc["left"], lambda y, i: F.when(i + 1 == at, F.lit("")).otherwise(y))
        return F.struct(left.alias("left"), (acc["score"] + (at > 0).cast("int")).alias("score"))

    score = F.aggregate(ta, first, step, lambda acc: acc["score"])
    some = (F.size(ta) > 0) & (F.size(tb) > 0)
    return F.when(some, F.least(F.lit(100.0), 100 * score / F.greatest(weight_a, weight_b))).otherwise(F.lit(0.0))


def _weight(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda n, t: n + F.when(one_of(WEAK_TOKENS, t), 0.5).otherwise(1.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Tokens of a, in order, take an equal token of b or else the first that abbreviates them or that they abbreviate.

    A match counts 1; the heavier side's weight, in which weak words are half, divides. The
    direction matters: call it with the first source's name first.
    """
    ta, tb = tokens(a), tokens(b)
    return _overlap(ta, tb, _weight(ta), _weight(tb))


def acronym(a: Column, b: Column) -> Column:
    """100 if one is a single token made of the initials of all tokens of the other."""

    def way(short: Column, long: Column) -> Column:
        initials = F.array_join(F.transform(tokens(long), lambda t: F.left(t, F.lit(1))), "")
        return (F.size(tokens(short)) == 1) & (F.length(short) >= 2) & (F.size(tokens(long)) >= 2) & (short == initials)

    return F.when(way(a, b) | way(b, a), F.lit(100.0)).otherwise(F.lit(0.0))


def team_similarity(a: Column, b: Column) -> Column:
    """Likeness of two teams' folded names, the score alone."""
    return similarity(a, b)


def league_similarity(a: Column, b: Column) -> Column:
    """Likeness of two leagues' folded names, the score alone."""
    return similarity(a, b)


def similarity(a: Column, b: Column) -> Column:
    none = F.coalesce(a, F.lit("")) == ""
    none = none | (F.coalesce(b, F.lit("")) == "")
    return F.when(none, F.lit(0.0)).when(a == b, F.lit(100.0)).otherwise(F.greatest(char_ratio(a, b), char_ratio(token_sort(a), token_sort(b)), token_overlap(a, b), acronym(a, b)))


def likeness_facts(a: Column) -> Column:
    """All of a name that `likeness` needs and that does not depend on the other name."""
    name, parts = F.coalesce(a, F.lit("")), tokens(a)
    begins = F.array_distinct(F.flatten(F.transform(parts, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substr(t, F.lit(1), n)))))
    letter = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(t), F.lit(64)))
    initials = F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda t: F.left(t, F.lit(1))), ""))
    return F.struct(
        name.alias("name"), token_sort(a).alias("sorted"), parts.alias("parts"), begins.alias("begins"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda m, t: m.bitwiseOR(letter(t))).alias("letters"),
        _weight(parts).alias("weight"), initials.alias("initials"), F.when((F.size(parts) == 1) & (F.length(name) >= 2), name).alias("short"),
    )


def likeness(x: Column, y: Column) -> Column:
    """`similarity` of two names' facts. Tokens are only walked through where one begins another."""
    a, b = x["name"], y["name"]
    met = (x["letters"].bitwiseAND(y["letters"]) != 0) & (F.arrays_overlap(x["parts"], y["begins"]) | F.arrays_overlap(x["begins"], y["parts"]))
    overlap = F.when(met, _overlap(x["parts"], y["parts"], x["weight"], y["weight"])).otherwise(F.lit(0.0))
    same = (a == x["sorted"]) & (b == y["sorted"])
    ordered = F.when(same, F.lit(0.0)).otherwise(char_ratio(x["sorted"], y["sorted"]))
    initials = F.when(F.coalesce((x["short"] == y["initials"]) | (y["short"] == x["initials"]), F.lit(False)), F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(100.0)).otherwise(F.greatest(char_ratio(a, b), ordered, overlap, initials))
