"""Calendar buckets of a timestamp column."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each granularity.
GRANULARITIES = {
    "minute": ["minute", "min", "1m"],
    "hourly": ["hourly", "hour", "1h"],
    "daily": ["daily", "day", "1d"],
    "weekly": ["weekly", "week", "1w"],
    "monthly": ["monthly", "month"],
    "quarterly": ["quarterly", "quarter"],
    "yearly": ["yearly", "year", "1y"],
}

_UNITS = {
    "minute": "MINUTE",
    "hourly": "HOUR",
    "weekly": "WEEK",
    "monthly": "MONTH",
    "quarterly": "QUARTER",
    "yearly": "YEAR",
}


def parse_granularity(text: str) -> str:
    for name, spellings in GRANULARITIES.items():
        if text.lower() in spellings:
            return name
    raise ValueError(f"unknown granularity {text!r}")


def bucket(granularity: str | None, ts: Column) -> Column | None:
    """The bucket's first moment: a timestamp below a day, a date from a day up, None for rolling."""
    if granularity is None:
        return None
    name = parse_granularity(granularity)
    if name == "daily":
        return ts.cast("date")
    if name in ("minute", "hourly"):
        return F.date_trunc(_UNITS[name], ts).cast("timestamp_ntz")
    return F.trunc(ts.cast("date"), _UNITS[name])


def bucket_offset(granularity: str, date: Column, origin: datetime) -> Column:
    """How many buckets lie between the bucket that holds ``origin`` and ``date``."""
    name = parse_granularity(granularity)
    start = F.lit(origin.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    first = bucket(name, start)
    if name in ("minute", "hourly"):
        return F.timestamp_diff(_UNITS[name], first, date).cast("bigint")
    if name in ("daily", "weekly"):
        days = F.datediff(date, first)
        return (days if name == "daily" else F.floor(days / 7)).cast("bigint")
    months = (F.year(date) - F.year(first)) * 12 + F.month(date) - F.month(first)
    width = {"monthly": 1, "quarterly": 3, "yearly": 12}[name]
    return F.floor(months / width).cast("bigint")
