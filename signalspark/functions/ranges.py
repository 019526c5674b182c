"""Time ranges: named, relative and explicit periods as inclusive second bounds in UTC."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_END = time(23, 59, 59)


@dataclass(frozen=True)
class Range:
    """A period whose two bounds both belong to it."""

    start: datetime
    end: datetime

    def previous_period(self) -> Range:
        length = self.end - self.start
        second = timedelta(seconds=1)
        return Range(self.start - length - second, self.start - second)

    def previous_year(self) -> Range:
        """Both bounds a year earlier; 29 February stays, which may leave an empty period."""
        return Range(_year_earlier(self.start), _year_earlier(self.end))

    def duration(self) -> timedelta:
        return self.end - self.start

    def days(self) -> int:
        return (self.end.date() - self.start.date()).days + 1

    def predicate(self, df: DataFrame, ts: str = "timestamp") -> Column:
        """Both bounds as literals of the column's own type, so that they reach the scan.

        Where the table says that its folders go by the day of this column, they are bounded too.
        """
        high = _typed_literal(self.end, df.schema[ts].dataType)
        return since(df, self.start, ts) & (F.col(ts) <= high) & _days(df, ts, None, self.end)

    def dates(self) -> list[date]:
        """The days whose folders may hold rows of the period; one more on either side, for any time zone."""
        first = self.start.date() - timedelta(days=1)
        return [first + timedelta(days=i) for i in range((self.end.date() - first).days + 2)]


#: Key in a date column's metadata that names the time column whose day it is.
DAY_OF = "day_of"


def _by_day(df: DataFrame, ts: str) -> bool:
    return "date" in df.columns and df.schema["date"].metadata.get(DAY_OF) == ts


def _days(df: DataFrame, ts: str, low: datetime | None, high: datetime | None) -> Column:
    """Bounds on the day folders, a day wider on either side than the times, for any time zone."""
    day, test = timedelta(days=1), F.lit(True)
    if _by_day(df, ts):
        if low is not None:
            test &= F.col("date") >= F.lit((low - day).strftime("%Y-%m-%d")).cast("date")
        if high is not None:
            test &= F.col("date") <= F.lit((high + day).strftime("%Y-%m-%d")).cast("date")
    return test


def since(df: DataFrame, moment: datetime, ts: str = "timestamp") -> Column:
    """Rows from a moment on, bounded by day folders too where there are any."""
    return (F.col(ts) >= _typed_literal(moment, df.schema[ts].dataType)) & _days(df, ts, moment, None)


def _typed_literal(moment: datetime, kind: T.DataType) -> Column:
    text = moment.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        return F.lit(text[:10]).cast("date")
    return F.lit(text + " UTC").cast("timestamp")


def _year_earlier(moment: datetime) -> datetime:
    try:
        return moment.replace(year=moment.year - 1)
    except ValueError:
        return moment


def _months_earlier(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def _span(first: date, last: date) -> Range:
    return Range(datetime.combine(first, time()), datetime.combine(last, DAY_END))


def _named(text: str, today: date) -> Range | None:
    starts = {
        "today": today,
        "wtd": today - timedelta(days=today.weekday()),
        "mtd": today.replace(day=1),
        "qtd": today.replace(month=(today.month - 1) // 3 * 3 + 1, day=1),
        "ytd": today.replace(month=1, day=1),
        "3m": _months_earlier(today, 3),
        "6m": _months_earlier(today, 6),
        "12m": _months_earlier(today, 12),
    }
    if text == "yesterday":
        return _span(today - timedelta(days=1), today - timedelta(days=1))
    return _span(starts[text], today) if text in starts else None


def _relative(text: str, now: datetime) -> Range | None:
    found = re.fullmatch(r"\+?(\d+)([hdwmy])", text, re.ASCII)
    if not found or int(found[1]) == 0:
        return None
    count = int(found[1])
    back = {
        "h": timedelta(hours=count),
        "d": timedelta(days=count - 1),
        "w": timedelta(days=7 * count - 1),
        "m": timedelta(days=30 * count - 1),
        "y": timedelta(days=365 * count - 1),
    }[found[2]]
    return _span((now - back).date(), now.date())


def _explicit(text: str) -> Range | None:
    parts = [part.strip() for part in text.split(",")]
    if len(parts) != 2:
        return None
    try:
        first, last = (datetime.strptime(part, "%Y-%m-%d").date() for part in parts)
    except ValueError:
        raise ValueError(f"invalid date in {text!r} (use YYYY-MM-DD)") from None
    if last < first:
        raise ValueError(f"range {text!r} ends before it starts")
    return _span(first, last)


def parse_range(text: str, now: datetime | None = None) -> Range:
    """Named periods first, then ``<n><unit>``, then ``YYYY-MM-DD,YYYY-MM-DD``."""
    now = now or datetime.now(timezone.utc)
    if now.tzinfo is not None:
        now = now.astimezone(timezone.utc).replace(tzinfo=None)
    key = text.strip().lower()
    found = _named(key, now.date()) or _relative(key, now) or _explicit(key)
    if found is None:
        raise ValueError(f"unknown time range {text!r}")
    return found
