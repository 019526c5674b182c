"""Boards: many series over one scan of each table.

Every row is handed on once for each series that counts it, with the series' bucket and dimension; one
aggregation then makes the points of all series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions.buckets import bucket, bucket_offset, parse_granularity
from signalspark.functions.filters import Filter, field_column
from signalspark.schema import Frames


@dataclass(frozen=True)
class Series:
    """What one series counts: rows of ``table``, or different values of ``distinct``.

    dimension: splits every bucket. share: values in percent of their sum. top: no buckets, but the
    ``filter.limit`` largest dimensions. period: ``current`` or ``previous`` where two are compared.
    """

    name: str
    table: str
    filter: Filter
    ts: str = "timestamp"
    distinct: str | None = None
    dimension: str | None = None
    share: bool = False
    top: bool = False
    period: str | None = None


def _counted(df: DataFrame, series: list[tuple[int, Series]]) -> DataFrame:
    """Number of the series, date, dimension and value of all points of a table's series."""
    tests, rows = [], []
    for number, s in series:
        test = s.filter.time_range.predicate(df, s.ts)
        for condition in s.filter.conditions:
            test = test & condition.to_column(df)
        date = None if s.top else bucket(s.filter.granularity, df[s.ts])
        none = F.lit(None)
        row = F.struct(
            F.lit(number).alias("series"),
            (none if date is None else date).cast("timestamp_ntz").alias("date"),
            (none if s.dimension is None else field_column(df, s.dimension)).cast("string").alias("dimension"),
            (none if s.distinct is None else field_column(df, s.distinct)).cast("string").alias("item"),
        )
        tests.append(test)
        rows.append(F.when(test, row))
    kept = df.where(reduce(lambda a, b: a | b, tests)).select(F.inline(F.array_compact(F.array(*rows))))
    points = kept.groupBy("series", "date", "dimension").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("item").alias("items")
    )
    value = F.when(_picked(series, lambda s: s.distinct is not None), F.col("items")).otherwise(F.col("rows"))
    return points.select("series", "date", "dimension", value.cast("double").alias("value"))


def _picked(series: Iterable[tuple[int, Series]], test: Callable[[Series], bool]) -> Column:
    """Whether a row is of a series with some quality."""
    return F.col("series").isin([number for number, s in series if test(s)])


def points(frames: Frames, series: list[Series]) -> DataFrame:
    """``series``, ``date``, ``dimension`` and ``value`` of every point, and with comparisons ``period`` and
    ``bucket_offset``. Limits hold per series: its first buckets, or its largest dimensions."""
    numbered = list(enumerate(series))
    tables = dict.fromkeys(s.table for s in series)
    made = [_counted(frames.get(t), [(n, s) for n, s in numbered if s.table == t]) for t in tables]
    found = reduce(DataFrame.unionByName, made)
    own = Window.partitionBy("series")
    # No more than the points of one series reach these windows.
    limits = [(n, s) for n, s in numbered if s.filter.limit is not None]
    if limits:
        place = F.row_number().over(
            own.orderBy(F.when(_picked(numbered, lambda s: s.top), -F.col("value")), "date", "dimension")
        )
        most = F.create_map(*[F.lit(x) for n, s in limits for x in (n, s.filter.limit)])
        found = found.withColumn("place", place).where(F.coalesce(F.col("place") <= most[F.col("series")], F.lit(True)))
    if any(s.share for s in series):
        total = F.sum("value").over(own)
        share = F.when(total > 0, F.col("value") / total * 100).otherwise(F.lit(0.0))
        found = found.withColumn("value", F.when(_picked(numbered, lambda s: s.share), share).otherwise(F.col("value")))
    dated = [s for s in series if not s.top and s.filter.granularity]
    coarse = all(parse_granularity(s.filter.granularity) not in ("minute", "hourly") for s in dated)
    columns = [F.create_map(*[F.lit(x) for n, s in numbered for x in (n, s.name)])[F.col("series")].alias("series")]
    if any(s.period for s in series):
        periods = F.create_map(*[F.lit(x) for n, s in numbered for x in (n, s.period)])
        offset = F.lit(None).cast("bigint")
        for n, s in numbered:
            if s.period and s.filter.granularity and not s.top:
                fine = parse_granularity(s.filter.granularity) in ("minute", "hourly")
                date = F.col("date") if fine else F.col("date").cast("date")
                one = bucket_offset(s.filter.granularity, date, s.filter.time_range.start)
                offset = F.when(F.col("series") == n, one).otherwise(offset)
        columns += [periods[F.col("series")].alias("period"), offset.alias("bucket_offset")]
    if dated:
        columns.append((F.col("date").cast("date") if coarse else F.col("date")).alias("date"))
    return found.select(*columns, "value", "dimension")
