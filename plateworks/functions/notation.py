"""Identifiers and times that are written in several ways, brought to one form as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that print nothing.
INVISIBLE = "[\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f\\ufe00-\\ufe0f\\ufeff]"

_HEX = (
    "^(?:[a-z]+[0-9]{0,3})??[^0-9a-z]*([0-9a-f]{%s})(?:\\.[a-z0-9]+)?$"
)


def squeeze(c: Column) -> Column:
    """Lower case without blanks at the ends and without characters that print nothing."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), "(?U)^\\s+|\\s+$", "")))


def hex_id(c: Column, digits: int) -> Column:
    """The hex identifier of so many digits in a value like `paper_<hex>`, `SHA256:<HEX>` or ` <hex>.pdf`; else null."""
    found = F.regexp_extract(squeeze(c), _HEX % digits, 1)
    return F.when(found != "", found)


def instant(c: Column) -> Column:
    """Microseconds since 1970 of an ISO text in any offset notation; without an offset it is UTC; null if unreadable."""
    t = F.trim(c)
    zoned = F.when(t.rlike("(?i)(z|[+-][0-9]{2}:?[0-9]{2})$") & t.rlike("[0-9]:[0-9]"), t).otherwise(F.concat(t, F.lit("+00:00")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def plain(c: Column) -> Column:
    """Lower case, trimmed; blank is null."""
    s = squeeze(c)
    return F.when(s != "", s)
