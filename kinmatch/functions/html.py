"""Entities, tags and attributes of HTML, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITY = "&(?:#[xX][0-9a-fA-F]+|#\\d+|quot|apos|amp|lt|gt|nbsp);"
_NAMED = {"&quot;": '"', "&apos;": "'", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " "}


def _char(code: Column) -> Column:
    """The character of a code point, "" if it is not one."""
    ok = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")).otherwise(F.lit(""))


def decode_entities(c: Column) -> Column:
    """Numeric and the common named references, in one pass: what they give is not read again."""
    number = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);$", 1), 16, 10).try_cast("bigint")).otherwise(F.regexp_extract(e, "(\\d+);$", 1).try_cast("bigint"))
    named = lambda e: F.try_element_at(F.create_map(*(F.lit(x) for kv in _NAMED.items() for x in kv)), e)
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({_ENTITY})"), F.lit(1)), lambda e: F.coalesce(named(e), _char(number(e)), e))
    parts = F.split(c, _ENTITY, -1)
    mixed = F.zip_with(parts, found, lambda p, f: F.concat(p, F.coalesce(f, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(mixed, "")).otherwise(c)


def strip_tags(c: Column) -> Column:
    return decode_entities(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " ")))


def attributes(tag: Column) -> Column:
    """map of an opening tag's attributes, names in lower case, the last of a name."""
    form = "([:\\w-]+)\\s*=\\s*(?:\"([^\"\\n]*)\"|'([^'\\n]*)')"
    names = F.transform(F.regexp_extract_all(tag, F.lit(form), F.lit(1)), F.lower)
    doubles, singles = (F.regexp_extract_all(tag, F.lit(form), F.lit(k)) for k in (2, 3))
    values = F.zip_with(doubles, singles, lambda d, s: decode_entities(F.concat(F.coalesce(d, F.lit("")), F.coalesce(s, F.lit("")))))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(names, p["i"] + 2, F.greatest(F.size(names), F.lit(1))), lambda n: n == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
