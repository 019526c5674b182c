"""Engagement, product and log metrics over the analytics tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions.filters import DEFAULT_DRILL, DEFAULT_TOP, Filter
from signalspark.functions.ranges import Range
from signalspark.operators import aggregates as agg
from signalspark.schema import Frames


def active_users(frames: Frames, f: Filter, by: str | None = None) -> DataFrame:
    """Distinct devices per bucket of the filter, split by ``by`` or the filter's breakdown."""
    return agg.count_distinct_query(frames.get("context"), "device_id", f, by=by or f.breakdown)


def dau(frames: Frames, f: Filter) -> DataFrame:
    return active_users(frames, f)


def wau(frames: Frames, f: Filter) -> DataFrame:
    return active_users(frames, f)


def mau(frames: Frames, f: Filter) -> DataFrame:
    return active_users(frames, f)


def _volume(df: DataFrame, f: Filter, by: str | None) -> DataFrame:
    dimension = by or f.breakdown
    if dimension is None:
        return agg.count_query(df, f)
    return agg.breakdown_query(df, F.count(F.lit(1)), dimension, f)


def sessions(frames: Frames, f: Filter, by: str | None = None) -> DataFrame:
    return _volume(frames.get("context"), f, by)


def unique_sessions(frames: Frames, f: Filter, by: str | None = None) -> DataFrame:
    return agg.count_distinct_query(frames.get("context"), "session_id", f, by=by or f.breakdown)


def top_sessions(frames: Frames, f: Filter, field: str = "device_type", n: int = DEFAULT_TOP) -> DataFrame:
    return agg.top_n(frames.get("context"), field, f, n=n)


def users_count(frames: Frames, f: Filter) -> DataFrame:
    return agg.count_query(frames.get("users"), f, ts="updated_at")


def distinct_users(frames: Frames, f: Filter) -> DataFrame:
    return agg.count_distinct_query(frames.get("context"), "device_id", f)


def stickiness_share(frames: Frames, f: Filter) -> DataFrame:
    """Each bucket's active users in percent of the sum over all buckets of the period."""
    points = agg.count_distinct_query(frames.get("context"), "device_id", f)
    if f.granularity is None:
        points = points.withColumn("date", F.lit(None).cast("date"))
    # One row per bucket is all that reaches this window.
    total = F.sum("value").over(Window.partitionBy())
    share = F.when(total > 0, F.col("value") / total * 100).otherwise(F.lit(0.0))
    return points.select("date", share.alias("value"))


def stickiness_ratio(frames: Frames, f: Filter, num: str = "day", den_days: int = 30) -> DataFrame:
    """Active devices of a day (or of the 7 days up to it) in percent of those of the last ``den_days`` days.

    A device seen on some day counts for the following window until it is seen again, so each
    (device, day) turns into one rise and one fall. Adding these up per day and then along the
    calendar gives the exact rolling distinct count without copying rows into every window.
    """
    widths = {"numerator": {"day": 1, "week": 7}[num], "denominator": den_days}
    first, last = f.time_range.start.date(), f.time_range.end.date()
    reach = max(widths.values()) - 1
    wider = replace(f, time_range=Range(f.time_range.start - timedelta(days=reach), f.time_range.end))
    active = (
        wider.apply(frames.get("context")).select("device_id", F.to_date("timestamp").alias("day")).distinct()
    )
    following = F.lead("day").over(Window.partitionBy("device_id").orderBy("day"))
    seen = active.withColumn("next_day", following)

    steps = []
    for name, width in widths.items():
        falls = F.least(F.date_add("day", width), F.col("next_day"))
        steps += [
            F.struct(F.col("day").alias("date"), *[F.lit(int(n == name)).alias(n) for n in widths]),
            F.struct(falls.alias("date"), *[F.lit(-int(n == name)).alias(n) for n in widths]),
        ]
    deltas = seen.select(F.inline(F.array(*steps)))
    calendar = frames.get("context").sparkSession.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"),
        *[F.lit(0).alias(name) for name in widths],
    )
    per_day = deltas.unionByName(calendar).groupBy("date").agg(*[F.sum(name).alias(name) for name in widths])
    # One row per day is all that reaches this window.
    running = Window.partitionBy().orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = per_day.select("date", *[F.sum(name).over(running).alias(name) for name in widths])
    inside = F.col("date").between(F.lit(first), F.lit(last)) & (F.col("denominator") > 0)
    return levels.where(inside).select("date", (F.col("numerator") / F.col("denominator") * 100).alias("value"))


def event_count(frames: Frames, f: Filter, name: str | None = None, by: str | None = None) -> DataFrame:
    return _volume(frames.get("events"), f.where(event=name), by)


def top_events(frames: Frames, f: Filter, n: int = DEFAULT_TOP) -> DataFrame:
    return agg.top_n(frames.get("events"), "event_name", f, n=n)


def event_property_breakdown(frames: Frames, f: Filter, event: str, prop: str) -> DataFrame:
    return agg.breakdown_query(frames.get("events"), F.count(F.lit(1)), prop, f.where(event=event))


def custom_event_metric(frames: Frames, f: Filter, event: str, prop: str, fn: str) -> DataFrame:
    return agg.custom_aggregate(frames.get("events"), prop, fn, f.where(event=event))


def log_volume(frames: Frames, f: Filter, level: str | None = None, by: str | None = None) -> DataFrame:
    return _volume(frames.get("logs"), f.where(level=level), by)


def top_logs(frames: Frames, f: Filter, field: str = "level", n: int = DEFAULT_TOP) -> DataFrame:
    return agg.top_n(frames.get("logs"), field, f, n=n)


def drill_users(frames: Frames, f: Filter, n: int = DEFAULT_DRILL) -> DataFrame:
    return agg.distinct_values(frames.get("context"), "device_id", f, n=n)


def drill_sessions(frames: Frames, f: Filter, n: int = DEFAULT_DRILL) -> DataFrame:
    return agg.distinct_values(frames.get("context"), "session_id", f, n=n)


def drill_events(frames: Frames, f: Filter, n: int = DEFAULT_DRILL, event: str | None = None) -> DataFrame:
    columns = ["timestamp", "event_name", "device_id", "session_id"]
    return agg.raw_data(frames.get("events"), columns, f.where(event=event), n=n)


def drill_logs(frames: Frames, f: Filter, n: int = DEFAULT_DRILL) -> DataFrame:
    return agg.raw_data(frames.get("logs"), ["timestamp", "level", "message", "source"], f, n=n)


Metric = Callable[[Frames, Filter], DataFrame]


def with_comparison(metric: Metric, frames: Frames, f: Filter, with_points: bool = False) -> DataFrame:
    """A metric over the filter's period and its comparison period, as totals or point by point."""
    current, previous = metric(frames, replace(f, compare=None)), metric(frames, f.comparison())
    if with_points:
        return agg.compare_points(current, previous, f)
    return agg.compare(current, previous)
