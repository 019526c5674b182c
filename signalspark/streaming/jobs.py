"""Streaming queries around the batch operators, and the one operator that needs state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalspark.operators.reduce import ReduceConfig, epoch_ms, next_start, reduce_key
from signalspark.operators.routing import Rule, for_sink, route
from signalspark.operators.tables import unsupported
from signalspark.sinks.files import stream_batch, write_batch, write_tables
from signalspark.sources.jsonl import (
    assign_workspace,
    check_event_lines,
    check_log_lines,
    events_of,
    logs_of,
    read_lines,
    rejected_of,
)


def _ingest(
    spark: SparkSession, source: str, base: str, checkpoint: str, workspace: int | None, keys: DataFrame | None,
    check: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], None], kind: str,
) -> DataStreamWriter:
    """Parse each micro-batch once; stored rows, rejected lines and counts of unstored types all land."""
    if (workspace is None) == (keys is None):
        raise ValueError("give a workspace or a table of keys")

    def run(batch: DataFrame, batch_id: int) -> None:
        name = stream_batch(batch, batch_id)
        checked = check(batch).persist()
        try:
            write(checked, name)
            rejected = rejected_of(checked)
            write_batch(rejected, f"{base.rstrip('/')}/_rejected/{kind}", name)
        finally:
            checked.unpersist()

    return read_lines(spark, source, streaming=True).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _scoped(rows: DataFrame, workspace: int | None, keys: DataFrame | None) -> DataFrame:
    return rows.withColumn("workspace_id", F.lit(workspace)) if keys is None else assign_workspace(rows, keys)


def ingest_events(
    spark: SparkSession, source: str, base: str, checkpoint: str, workspace: int | None = None,
    now_ms: int | None = None, keys: DataFrame | None = None,
) -> DataStreamWriter:
    """JSON-lines files to the typed tables; a repeated micro-batch replaces what it wrote before.

    Rows go to one workspace, or with ``keys`` (api_key, workspace_id) to that of their folder
    ``api_key=...``. Rejected lines land under ``_rejected/events`` with the reason, counts of event
    types that no table takes under ``_unstored``.
    """

    def write(checked: DataFrame, name: str) -> None:
        events = _scoped(events_of(checked, now_ms), workspace, keys)
        write_tables(base, events=events, batch=name)
        unstored = unsupported(events).groupBy("workspace_id", "event_type").agg(F.count("*").alias("n"))
        write_batch(unstored, f"{base.rstrip('/')}/_unstored", name)

    return _ingest(spark, source, base, checkpoint, workspace, keys, check_event_lines, write, "events")


def ingest_logs(
    spark: SparkSession, source: str, base: str, checkpoint: str, workspace: int | None = None,
    now_ms: int | None = None, keys: DataFrame | None = None,
) -> DataStreamWriter:
    """JSON-lines files to the log table; rejected lines land under ``_rejected/logs``."""

    def write(checked: DataFrame, name: str) -> None:
        write_tables(base, logs=_scoped(logs_of(checked, now_ms), workspace, keys), batch=name)

    return _ingest(spark, source, base, checkpoint, workspace, keys, check_log_lines, write, "logs")


def route_stream(
    stream: DataFrame, rules: Iterable[Rule], sinks: Mapping[str, Callable[[DataFrame, int], None]],
    default: Iterable[str] = (),
) -> DataStreamWriter:
    """Each micro-batch to the sinks its rows are routed to; the batch is computed once."""
    routed = route(stream, rules, default)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, sink in sinks.items():
                sink(for_sink(kept, name), batch_id)
        finally:
            kept.unpersist()

    return routed.writeStream.foreachBatch(write)


def windowed_counts(
    stream: DataFrame, ts: str = "timestamp", width: str = "1 day", late: str = "1 hour", by: str | None = None
) -> DataFrame:
    """Rows per time window (and dimension); rows later than ``late`` no longer count."""
    keys = [F.window(ts, width)] + ([F.col(by).alias("dimension")] if by else [])
    counted = stream.withWatermark(ts, late).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    rest = ["dimension"] if by else []
    return counted.select(F.col("window.start").alias("date"), *rest, "value")


def without_repeats(stream: DataFrame, key: str, ts: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """One row per key among rows no further apart than ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


REDUCED = "key string, message string, first_ts bigint, last_ts bigint, count bigint"
_OPEN_GROUP = "message string, first_ts bigint, last_ts bigint, count bigint"


def _reduce_key_group(config: ReduceConfig):
    """Keep one open group per key, batch by batch as rows arrive."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "message", "first_ts", "last_ts", "count"]
        if state.hasTimedOut:
            closed = [(key[0], *state.get)]
            state.remove()
            yield pd.DataFrame(closed, columns=columns)
            return
        group = tuple(state.get) if state.exists else None
        # A key's rows of one batch may come in several chunks; order holds over all of them.
        rows = pd.concat(list(chunks)).sort_values("ts", kind="stable")
        times, messages = rows["ts"].to_numpy(), rows["message"].to_numpy()
        closed, at, size = [], 0, len(rows)
        if group is not None:
            at = int(min(np.searchsorted(times, group[1] + config.window_ms), config.max_events - group[3]))
            if at:
                group = (group[0], group[1], max(int(times[at - 1]), group[2]), group[3] + at)
            if at < size or group[3] >= config.max_events:
                closed.append((key[0], *group))
                group = None
        following = next_start(times, np.full(size, size), config.window_ms, config.max_events) if size else []
        while at < size:
            stop = int(following[at])
            group = (messages[at], int(times[at]), int(times[stop - 1]), stop - at)
            if stop < size or group[3] >= config.max_events:
                closed.append((key[0], *group))
                group = None
            at = stop
        yield pd.DataFrame(closed, columns=columns)
        if group is None:
            if state.exists:
                state.remove()
        else:
            state.update(group)
            state.setTimeoutDuration(config.window_ms)

    return run


def reduce_stream(
    stream: DataFrame, config: ReduceConfig, message: str = "message", ts: str = "timestamp"
) -> DataFrame:
    """Collapse repeats on a stream.

    Rows close groups by event time and by count, as in the batch operator; a group that takes in
    nothing more is closed one window later by the clock, so the query keeps running batches: give
    it a processing-time trigger, as ``availableNow`` would wait for ever. ``operators.reduce.with_reduction``
    writes the counts into the messages, as in batch.
    """
    keyed = reduce_key(stream, config.group_by, message, "key")
    rows = keyed.select("key", epoch_ms(keyed, ts).alias("ts"), F.col(message).alias("message"))
    return rows.groupBy("key").applyInPandasWithState(
        _reduce_key_group(config), REDUCED, _OPEN_GROUP, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
