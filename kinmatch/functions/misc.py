"""Small helpers that queries and services share."""

from __future__ import annotations

import secrets
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as an address.
ADDRESS = r"(https:\/\/www\.|http:\/\/www\.|https:\/\/|http:\/\/)?[a-zA-Z0-9]{2,}\.[a-zA-Z0-9]{2,}\.[a-zA-Z0-9]{2,}(\.[a-zA-Z0-9]{2,})?"


def is_address(c: Column) -> Column:
    return F.coalesce(c.rlike(ADDRESS), F.lit(False))


def fixed(c: Column, digits: int = 2) -> Column:
    """A number, or a text of one, at so many digits; null if it is none."""
    return F.round(c.try_cast("double"), digits)


def span(first: Column | int, last: Column | int) -> Column:
    """All whole numbers from first to last, both included; none if last is smaller."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def code(length: int = 6) -> str:
    """A random code of letters and digits."""
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(length))
