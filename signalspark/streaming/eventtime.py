"""Streaming operators with state that goes by event time: reduction, and a rate limit over the whole stream.

Both keep their state in RocksDB, which ``build_session`` chooses, and end under ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalspark.operators.reduce import ReduceConfig, epoch_ms, next_start, reduce_key

REDUCED = "key string, message string, first_ts bigint, last_ts bigint, count bigint"
_COLUMNS = ["key", "message", "first_ts", "last_ts", "count"]


class _Reducer(StatefulProcessor):
    """One key: rows whose time the watermark has not passed yet, and the open group.

    Rows are taken in the order of their times once nothing earlier can come, so the groups are those of
    the batch operator whatever order the rows came in.
    """

    def __init__(self, config: ReduceConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, message string")
        self.open = handle.getValueState("open", "message string, first_ts bigint, last_ts bigint, count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            self.waiting.appendList([(int(t), m) for t, m in zip(frame["ts"], frame["message"])])
            least = int(frame["ts"].min()) if least is None else min(least, int(frame["ts"].min()))
        if least is not None:
            self.handle.registerTimer(max(least, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, window, most = timerValues.getCurrentWatermarkInMs(), self.config.window_ms, self.config.max_events
        held = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        final = [r for r in held if r[0] <= mark]
        rest = held[len(final) :]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        group = tuple(self.open.get()) if self.open.exists() else None
        times, closed, at = np.array([t for t, _ in final], np.int64), [], 0
        if group is not None:
            at = int(min(np.searchsorted(times, group[1] + window), most - group[3]))
            if at:
                group = (group[0], group[1], int(times[at - 1]), group[3] + at)
            if at < len(times) or group[3] >= most:
                closed.append((key[0], *group))
                group = None
        following = next_start(times, np.full(len(times), len(times)), window, most) if len(times) else []
        while at < len(times):
            stop = int(following[at])
            group = (final[at][1], int(times[at]), int(times[stop - 1]), stop - at)
            if stop < len(times) or group[3] >= most:
                closed.append((key[0], *group))
                group = None
            at = stop
        if group is not None and mark >= group[1] + window - 1:  # what comes now is later than the window
            closed.append((key[0], *group))
            group = None
        if group is None:
            self.open.clear()
        else:
            self.open.update(group)
            self.handle.registerTimer(group[1] + window - 1)
        if rest:
            self.handle.registerTimer(rest[0][0])
        yield pd.DataFrame(closed, columns=_COLUMNS)

    def close(self) -> None:
        pass


def reduce_by_event_time(
    stream: DataFrame, config: ReduceConfig, message: str = "message", ts: str = "timestamp", late: str = "10 seconds"
) -> DataFrame:
    """Collapse repeats on a stream into the groups that the batch operator makes of the same rows.

    Rows may come out of order by up to ``late``; later ones are left out, as with any watermark. A group
    is put out once it is full, or once the watermark has passed its window. Rows without a time are groups of
    their own. Of rows of one key and time the lesser message comes first. ``operators.reduce.with_reduction``
    writes the counts into the messages.
    """
    keyed = reduce_key(stream, config.group_by, message, "key")
    rows = keyed.select("key", epoch_ms(keyed, ts).alias("ts"), F.col(message).alias("message"))
    timed = rows.where("ts IS NOT NULL").withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    groups = timed.groupBy("key").transformWithStateInPandas(
        _Reducer(config), outputStructType=REDUCED, outputMode="append", timeMode="eventtime"
    )
    none = F.lit(None).cast("bigint")
    alone = rows.where("ts IS NULL").select(
        "key", "message", none.alias("first_ts"), none.alias("last_ts"), F.lit(1).cast("bigint").alias("count")
    )
    return groups.unionByName(alone)


class _Limiter(StatefulProcessor):
    """One second: how many rows were passed on."""

    def __init__(self, n: int, ts: str, order: tuple[str, ...], columns: list[str]):
        self.n, self.places, self.columns = n, [ts, *order], columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.passed.get()[0] if self.passed.exists() else 0
        best = None
        for frame in rows:  # no more than the rows that may pass are held
            frame = frame[self.columns] if best is None else pd.concat([best, frame[self.columns]])
            best = frame.sort_values(self.places, kind="stable").head(self.n - before)
        if best is not None and len(best):
            self.passed.update((before + len(best),))
            self.handle.registerTimer(max(int(key[0].timestamp() * 1000) + 1000, timerValues.getCurrentWatermarkInMs() + 1))
            yield best
        else:
            yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def limit_stream(
    stream: DataFrame, n: int, ts: str = "timestamp", order: Iterable[str] = (), late: str = "10 seconds"
) -> DataFrame:
    """The first n rows of every second of a stream, however its rows are spread over micro-batches.

    Within a micro-batch rows go by time, then ``order``; a row of an earlier micro-batch comes first. A
    second is forgotten ``late`` after it is over, and rows that are later than that are left out.
    """
    second = F.date_trunc("SECOND", F.col(ts)).cast("timestamp")
    marked = stream.withColumn("_second", second).withWatermark("_second", late)
    return marked.groupBy("_second").transformWithStateInPandas(
        _Limiter(n, ts, tuple(order), stream.columns), outputStructType=stream.schema, outputMode="append",
        timeMode="eventtime",
    )
