"""Live-tail selections; each works on a stream and on a landed table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_REPLAY = 1000
# Above this, Spark no longer cuts each second's rows before the shuffle, and the ranking goes in two steps.
ONE_STEP = 1000
PIECES = 64


def tail_meta(
    df: DataFrame, workspaces: Iterable[int] | None = None, sources: Iterable[str] | None = None,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """Rows whose workspace, source and batch type are in the given lists; no list means any."""
    for column, wanted in (("workspace_id", workspaces), ("source_id", sources), ("batch_type", types)):
        if wanted is not None:
            df = df.where(F.col(column).isin(list(wanted)))
    return df


def glob_regex(glob: str) -> str:
    """``*`` is any text, ``?`` any one character, all else itself."""
    parts = [{"*": ".*", "?": "."}.get(piece, re.escape(piece)) for piece in re.split(r"([*?])", glob) if piece]
    return rf"(?s)^(?:{''.join(parts)})\z"


def tail_names(df: DataFrame, globs: Iterable[str], column: str = "event_name") -> DataFrame:
    """Events whose name matches any of the globs; a missing name counts as an empty one."""
    name = F.coalesce(F.col(column), F.lit(""))
    tests = [name.rlike(glob_regex(glob)) for glob in globs]
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df


def tail_levels(df: DataFrame, levels: Iterable[str]) -> DataFrame:
    wanted = [level.lower() for level in levels]
    return df.where(F.lower("level").isin(wanted)) if wanted else df


def tail_match(
    df: DataFrame, text: str, columns: Iterable[str] = ("event_name", "source", "service", "payload"),
    regex: bool = False,
) -> DataFrame:
    """Rows with the text in any of the columns they have; with ``regex`` it is a pattern."""
    if not text:
        return df

    def holds(column: str) -> Column:
        found = F.col(column).rlike(text) if regex else F.contains(F.col(column), F.lit(text))
        return F.coalesce(found, F.lit(False))

    return df.where(reduce(lambda a, b: a | b, [holds(c) for c in columns if c in df.columns]))


def tail_sample(df: DataFrame, rate: float | None, by: str | None = None) -> DataFrame:
    """A random share of the rows; with ``by``, the same rows each time, chosen by that column's hash."""
    if rate is None or rate >= 1.0:
        return df
    if rate <= 0.0:
        return df.where(F.lit(False))
    if by is None:
        return df.where(F.rand() < rate)
    place = F.conv(F.substring(F.md5(F.col(by).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(place < int(rate * 2**32))


def tail_rate(df: DataFrame, n: int, ts: str = "timestamp", order: Iterable[str] = ()) -> DataFrame:
    """The first n rows of every second."""
    second = F.date_trunc("SECOND", ts)
    places = [F.col(ts), *[F.col(c) for c in order]]

    def first(rows: DataFrame, *keys: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*places))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    if n > ONE_STEP:
        piece = F.pmod(F.xxhash64(*places), F.lit(PIECES))
        df = first(df, second, piece)
    return first(df, second)


def tail_last(df: DataFrame, n: int = DEFAULT_REPLAY, ts: str = "timestamp", order: Iterable[str] = ()) -> DataFrame:
    """The newest n rows of a landed table."""
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in order]).limit(n)


def tail_format(df: DataFrame, fmt: str = "text", metadata_only: bool = False) -> DataFrame:
    """Rows as printable text.

    ``json`` and ``compact`` give one JSON object per row; ``raw`` and ``metadata_only`` give one
    line per workspace, source and batch type with its number of rows and payload bytes.
    """
    if fmt not in ("text", "json", "compact", "raw"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "raw" or metadata_only:
        batches = df.groupBy("workspace_id", "source_id", "batch_type").agg(
            F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")
        )
        if fmt in ("json", "compact"):
            return batches.select(F.to_json(F.struct(*batches.columns)).alias("value"))
        columns = [F.col(c).cast("string") for c in ("workspace_id", "source_id", "batch_type", "count", "bytes")]
        if fmt == "raw":
            return batches.select(F.format_string("workspace=%s source=%s type=%s count=%s bytes=%s", *columns).alias("value"))
        columns = [columns[0], F.upper("batch_type"), columns[1], *columns[3:]]
        return batches.select(F.format_string("[ws:%s] %s src=%s count=%s bytes=%s", *columns).alias("value"))
    if fmt in ("json", "compact"):
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    label = F.coalesce(*[F.col(c) for c in ("event_name", "level") if c in df.columns], F.lit("-"))
    return df.select(
        F.format_string(
            "%s %s %s",
            F.date_format("timestamp", "HH:mm:ss.SSS"),
            label,
            F.coalesce("payload", F.lit("")),
        ).alias("value")
    )


def rate_limited(write: Callable[[DataFrame, int], None], n: int, ts: str = "timestamp"):
    """A foreachBatch function that passes on the first n rows per second of each micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(tail_rate(batch, n, ts), batch_id)

    return run
