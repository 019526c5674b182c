"""Saved metric questions and boards that overlay several of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame

from signalspark.functions.buckets import parse_granularity
from signalspark.functions.filters import DEFAULT_TOP, Condition, Filter, parse_compare
from signalspark.functions.ranges import parse_range
from signalspark.operators import metrics as m
from signalspark.plans.boards import Series, points
from signalspark.schema import Frames

MAX_SERIES = 20

# Metric names of saved questions. Top lists take their size from the limit.
SERIES_METRICS = {
    "dau": m.dau,
    "wau": m.wau,
    "mau": m.mau,
    "events": m.event_count,
    "log_volume": m.log_volume,
    "sessions": m.sessions,
    "unique_sessions": m.unique_sessions,
    "stickiness": m.stickiness_share,
    "users": m.users_count,
}
TOP_METRICS = {"top_events": m.top_events, "top_logs": m.top_logs, "top_sessions": m.top_sessions}


@dataclass(frozen=True)
class MetricSpec:
    metric: str
    range: str
    filters: tuple[Condition, ...] = ()
    breakdown: str | None = None
    compare_mode: str | None = None
    limit: int | None = None
    granularity: str | None = None

    def filter(self, now: datetime | None = None) -> Filter:
        f = Filter(
            time_range=parse_range(self.range, now),
            granularity=parse_granularity(self.granularity or "daily"),
            conditions=tuple(self.filters),
            breakdown=self.breakdown,
            compare=parse_compare(self.compare_mode) if self.compare_mode else None,
        )
        return f if self.limit is None else f.with_limit(self.limit)


def run_spec(frames: Frames, spec: MetricSpec, now: datetime | None = None) -> DataFrame:
    """The points of a saved question; with a comparison mode, both periods with a ``period`` column."""
    f = spec.filter(now)
    if spec.metric in TOP_METRICS:
        top = TOP_METRICS[spec.metric]
        extra = {} if spec.breakdown is None or spec.metric == "top_events" else {"field": spec.breakdown}
        return top(frames, f, n=spec.limit or DEFAULT_TOP, **extra)
    if spec.metric not in SERIES_METRICS:
        raise ValueError(f"unknown metric {spec.metric!r}")
    metric = SERIES_METRICS[spec.metric]
    if f.compare is None:
        return metric(frames, f)
    return m.with_comparison(metric, frames, f, with_points=True)


# Of each metric, the table, what is counted distinctly, and whether it takes a breakdown.
_COUNTED = {
    "dau": ("context", "device_id", True),
    "wau": ("context", "device_id", True),
    "mau": ("context", "device_id", True),
    "events": ("events", None, True),
    "log_volume": ("logs", None, True),
    "sessions": ("context", None, True),
    "unique_sessions": ("context", "session_id", True),
    "stickiness": ("context", "device_id", False),
    "users": ("users", None, False),
}
_TOP_FIELDS = {"top_events": ("events", "event_name"), "top_logs": ("logs", "level"), "top_sessions": ("context", "device_type")}


def _series_of(name: str, spec: MetricSpec, now: datetime | None) -> list[Series]:
    """What a question counts: one series, or one for each period that it compares."""
    f = spec.filter(now)
    if spec.metric in _TOP_FIELDS:
        table, field = _TOP_FIELDS[spec.metric]
        if spec.metric != "top_events":
            field = spec.breakdown or field
        return [Series(name, table, f.with_limit(spec.limit or DEFAULT_TOP), dimension=field, top=True)]
    if spec.metric not in _COUNTED:
        raise ValueError(f"unknown metric {spec.metric!r}")
    table, distinct, splits = _COUNTED[spec.metric]
    one = Series(
        name, table, replace(f, compare=None), "updated_at" if table == "users" else "timestamp", distinct,
        spec.breakdown if splits else None, share=spec.metric == "stickiness",
    )
    if f.compare is None:
        return [one]
    return [replace(one, period="current"), replace(one, filter=f.comparison(), period="previous")]


def run_series(frames: Frames, specs: Mapping[str, MetricSpec], now: datetime | None = None) -> DataFrame:
    """One to twenty named questions laid over each other, in one scan of each table."""
    if not 1 <= len(specs) <= MAX_SERIES:
        raise ValueError(f"a block holds 1 to {MAX_SERIES} series")
    return points(frames, [s for name, spec in specs.items() for s in _series_of(name, spec, now)])
