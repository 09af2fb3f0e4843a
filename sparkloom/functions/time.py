"""Time functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stamp(c: Column | str) -> Column:
    """A time without zone from 14 or 12 digits; null where it can't be one."""
    digits = F.regexp_replace(_c(c), "[^0-9]", "")
    full = F.when(F.length(digits) == 12, F.concat(digits, F.lit("00"))).when(F.length(digits) == 14, digits)
    return F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def weekend(c: Column | str) -> Column:
    return F.dayofweek(_c(c)).isin(1, 7)


#: Schemes of day parts, each as (first hour at or after which it isn't valid, name), the last one for the rest.
DAY_PARTS = {
    "four": ((5, "night"), (12, "morning"), (17, "afternoon"), (21, "evening"), (24, "night")),
    "dawn": ((6, "dawn"), (12, "morning"), (18, "afternoon"), (24, "evening")),
    "six": ((6, "night"), (12, "morning"), (17, "afternoon"), (21, "evening"), (24, "night")),
}


def day_part(hour: Column | str, scheme: str = "four") -> Column:
    out = None
    for below, name in DAY_PARTS[scheme]:
        test = _c(hour) < below
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def bucket(c: Column | str, edges: list[float], names: list[str]) -> Column:
    """names[i] below edges[i], the last name from the last edge on; null stays null."""
    out = None
    for edge, name in zip(edges, names):
        out = F.when(_c(c) < edge, name) if out is None else out.when(_c(c) < edge, name)
    return out.when(_c(c).isNotNull(), names[len(edges)])


def even_positions(start: Column | str, end: Column | str, n: int) -> Column:
    """n evenly spaced whole positions from start to end, halves to even."""
    step = (_c(end) - _c(start)) / F.lit(max(n - 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(_c(start) + i * step).cast("bigint"))
