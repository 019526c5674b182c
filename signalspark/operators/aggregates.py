"""Counts, distinct counts, breakdowns, top lists and series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.buckets import bucket, bucket_offset
from signalspark.functions.filters import DEFAULT_DRILL, DEFAULT_TOP, Filter, field_column


def _value(agg: Column) -> Column:
    return agg.cast("double").alias("value")


def _series(df: DataFrame, f: Filter, ts: str, agg: Column, by: str | None = None) -> DataFrame:
    """One aggregate per bucket, or per bucket and dimension, or a single one when rolling."""
    kept = f.apply(df, ts)
    keys, order = [], []
    date = bucket(f.granularity, F.col(ts))
    if date is not None:
        keys.append(date.alias("date"))
        order.append("date")
    if by is not None:
        keys.append(field_column(kept, by).cast("string").alias("dimension"))
        order.append("dimension")
    if not keys:
        return kept.agg(_value(agg))
    points = kept.groupBy(*keys).agg(_value(agg))
    if f.limit is None:
        return points
    return f.capped(points.orderBy(*order))


def count_query(df: DataFrame, f: Filter, ts: str = "timestamp") -> DataFrame:
    return _series(df, f, ts, F.count(F.lit(1)))


def count_distinct_query(
    df: DataFrame, column: str, f: Filter, ts: str = "timestamp", by: str | None = None, approximate: bool = False
) -> DataFrame:
    """Exact distinct count; ``approximate`` trades exactness for one sketch per bucket."""
    values = field_column(df, column)
    agg = F.approx_count_distinct(values) if approximate else F.countDistinct(values)
    return _series(df, f, ts, agg, by)


def breakdown_query(df: DataFrame, agg: Column, dimension: str, f: Filter, ts: str = "timestamp") -> DataFrame:
    return _series(df, f, ts, agg, dimension)


def top_n(df: DataFrame, field: str, f: Filter, ts: str = "timestamp", n: int = DEFAULT_TOP) -> DataFrame:
    """The n most frequent values; equal counts are ordered by value."""
    kept = f.apply(df, ts)
    counted = kept.groupBy(field_column(kept, field).cast("string").alias("dimension")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return counted.orderBy(F.desc("value"), F.asc("dimension")).limit(n)


_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def custom_aggregate(df: DataFrame, prop: str, fn: str, f: Filter, ts: str = "timestamp") -> DataFrame:
    """sum / avg / min / max / count of a property; values that are not numbers count as missing."""
    if fn.lower() not in _FUNCTIONS:
        raise ValueError(f"unknown aggregate {fn!r}")
    number = field_column(df, prop)
    if prop not in df.columns:
        number = number.try_cast("double")
    return _series(df, f, ts, _FUNCTIONS[fn.lower()](number))


def raw_data(
    df: DataFrame, columns: list[str], f: Filter, ts: str = "timestamp", n: int = DEFAULT_DRILL
) -> DataFrame:
    """The newest n rows; equal times are ordered by the shown columns."""
    ties = [F.asc_nulls_first(name) for name in columns if name != ts]
    return f.apply(df, ts).select(*columns).orderBy(F.desc(ts), *ties).limit(n)


def distinct_values(
    df: DataFrame, column: str, f: Filter, ts: str = "timestamp", n: int = DEFAULT_DRILL
) -> DataFrame:
    kept = f.apply(df, ts)
    values = kept.select(field_column(kept, column).alias(column.split(".")[-1])).distinct()
    return values.orderBy(F.asc_nulls_first(values.columns[0])).limit(n)


def to_points(df: DataFrame) -> DataFrame:
    """Rename a result to date / value / dimension: known names first, any other column is the dimension."""
    date = next((c for c in ("date", "time", "hour") if c in df.columns), None)
    value = next(c for c in ("value", "count") if c in df.columns)
    rest = [c for c in df.columns if c not in ("date", "time", "hour", "value", "count")]
    picked = [F.col(date).alias("date")] if date else []
    picked.append(F.col(value).cast("double").alias("value"))
    picked += [F.col(c).cast("string").alias("dimension") for c in rest[:1]]
    return df.select(*picked)


def _stats() -> list[Column]:
    return [
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("min"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"),
    ]


def series_stats(points: DataFrame) -> DataFrame:
    """total, min, max and avg of a series in one row; zeros for an empty one."""
    return points.agg(*_stats())


def grouped_series(points: DataFrame) -> DataFrame:
    """Statistics per dimension, and in the row marked ``is_total`` over all of them."""
    return points.rollup("dimension").agg(
        *_stats(), F.grouping("dimension").cast("boolean").alias("is_total")
    )


def both_periods(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The two series as one frame with a ``period`` column."""
    marked = [
        points.select(F.lit(name).alias("period"), "*")
        for name, points in (("current", current), ("previous", previous))
    ]
    return marked[0].unionByName(marked[1], allowMissingColumns=True)


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Totals of both series, their difference, and the difference in percent of the previous total."""

    def total(period: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == period, F.col("value"))), F.lit(0.0))

    totals = both_periods(current, previous).agg(
        total("current").alias("current_total"), total("previous").alias("previous_total")
    )
    now, before = F.col("current_total"), F.col("previous_total")
    percent = (
        F.when(before != 0, (now - before) / before * 100)
        .when(now > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    return totals.select("*", (now - before).alias("change"), percent.alias("percent_change"))


def compare_points(current: DataFrame, previous: DataFrame, f: Filter) -> DataFrame:
    """Both series point by point; ``bucket_offset`` counts buckets from the start of each period."""
    if f.granularity is None:
        return both_periods(current, previous)
    pairs = ((current, f.time_range.start), (previous, f.comparison().time_range.start))
    aligned = [
        points.withColumn("bucket_offset", bucket_offset(f.granularity, F.col("date"), start))
        for points, start in pairs
    ]
    return both_periods(*aligned)
