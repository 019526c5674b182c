"""Collapse repeated messages: groups by key that close after a time window or a number of events.

A group opens at the first event after the last one closed, so where groups begin depends on all
earlier events of the key. Keys may be very unevenly filled, hence the work is laid out like this:

1. Rows are range-partitioned and sorted by (key, time, order). Ranges cut through a busy key, so
   no task holds much more than its share. The sorted rows are checkpointed.
2. Each partition reports, for a key that began further left, where a group carried into it would
   end, for every way this can turn out: at most ``max_events`` numbers.
3. These small reports are followed key by key, from which each partition knows how many of its first
   rows belong to a group from the left, and how a group that runs over its end is completed.
4. Each partition then emits its groups on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signalspark.functions.jsondoc import value_at, with_document, with_object
from signalspark.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class ReduceConfig:
    group_by: tuple[str, ...] = ()
    window_ms: int = 5000
    max_events: int = 1000
    min_events: int = 2

    def __post_init__(self):
        if self.window_ms <= 0:
            raise ValueError("window_ms must be greater than 0")
        if self.max_events < 1 or self.min_events < 1:
            raise ValueError("max_events and min_events must be at least 1")
        if self.min_events > self.max_events:
            raise ValueError("min_events cannot exceed max_events")


def reduce_key(df: DataFrame, group_by, message: str = "message", name: str = "key") -> DataFrame:
    """Add the grouping key: the present (field, value) pairs, or the whole message if it is not JSON."""
    if not group_by:
        return df.withColumn(name, F.col(message))
    parsed = with_document(df, F.col(message))
    pairs = []
    for field in group_by:
        value = value_at(F.col("_doc"), field)
        pair = F.concat(F.to_json(F.array(F.lit(field))), F.lit(":"), F.to_json(value))
        pairs.append(F.when(value.isNotNull(), pair))
    fields = F.concat(F.lit("fields:"), F.concat_ws(",", *pairs))
    whole = F.concat(F.lit("message:"), F.col(message))
    return parsed.withColumn(name, F.when(F.col("_doc").isNotNull(), fields).otherwise(whole)).drop("_doc")


def epoch_ms(df: DataFrame, ts: str) -> Column:
    """A time column as epoch milliseconds; numbers are taken as such."""
    if df.schema[ts].dataType.simpleString() in ("bigint", "int"):
        return F.col(ts).cast("bigint")
    return F.unix_millis(F.col(ts).cast("timestamp"))


def next_start(ts: np.ndarray, ends: np.ndarray, window: int, most: int) -> np.ndarray:
    """For each row, where the following group begins if one begins here; ``ends`` closes each key's run."""
    size = len(ts)
    rank = np.cumsum(np.concatenate(([0], (ends[1:] != ends[:-1]).astype(np.int64))))
    shifted = ts - ts.min()
    reach = min(window, int(shifted.max()) + 1)  # a longer window makes no difference
    line = rank * (int(shifted.max()) + reach + 1) + shifted
    later = np.searchsorted(line, line + reach, side="left")
    return np.minimum(np.minimum(later, np.arange(size) + most), ends)


def _run_ends(changed: np.ndarray, size: int) -> np.ndarray:
    """End of the run of equal keys that each row lies in; ``changed`` marks rows that start a run."""
    starts = np.flatnonzero(changed)
    bounds = np.append(starts[1:], size) if len(starts) else np.array([size])
    return np.repeat(bounds, np.diff(np.append(starts, size)))


def _changes(keys: pa.Array, before) -> np.ndarray:
    """Whether each key differs from the one above it, ``before`` standing above the first; nulls are equal."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    out = np.ones(len(keys), bool)
    out[0] = keys[0].as_py() != before
    if len(keys) > 1:
        above, below = keys.slice(0, len(keys) - 1), keys.slice(1)
        same = pc.fill_null(pc.equal(above, below), False).to_numpy(zero_copy_only=False)
        none = keys.is_null().to_numpy(zero_copy_only=False)
        out[1:] = ~(same | (none[1:] & none[:-1]))
    return out


REPORT = (
    "part int, key string, leads boolean, closes boolean, rows bigint, last_ts bigint,"
    " head_ts array<bigint>, exit_ts array<bigint>, exit_count array<bigint>"
)


def _exits(ts: np.ndarray, window: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """What a run of one key looks like from outside.

    ``head``: the times a carried group can still take in. For a group that begins at row i of
    the head: when the group left open at the end of the run began, and its size (0: none open).
    """
    size = len(ts)
    following = next_start(ts, np.full(size, size), window, most)
    reach = int(min(size, most, np.searchsorted(ts, ts[0] + window, side="left") + 1))
    # Where the chain of groups that begins at a row ends, by doubling the steps.
    last = np.where(following < size, following, np.arange(size))
    while not np.array_equal(last, further := last[last]):
        last = further
    held = size - last
    return ts[:reach].tolist(), ts[last][:reach].tolist(), np.where(held < most, held, 0)[:reach].tolist()


def _report(window: int, most: int):
    """One row per partition end: the key that leads it, and the key that closes it if that is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first_key, last_key = None, None, None
        runs: list[np.ndarray] = []
        rows: list[dict] = []
        started = False

        def close(leads: bool, closes: bool) -> None:
            ts = np.concatenate(runs)
            head, begun, count = _exits(ts, window, most)
            if not leads:  # nothing can be carried into a key that begins here
                head, begun, count = [], begun[:1], count[:1]
            rows.append(
                {
                    "part": part,
                    "key": last_key,
                    "leads": leads,
                    "closes": closes,
                    "rows": len(ts),
                    "last_ts": int(ts[-1]),
                    "head_ts": head,
                    "exit_ts": begun,
                    "exit_count": count,
                }
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, ts = batch["key"], batch["ts"].to_numpy(zero_copy_only=False)
            if not started:
                started, part = True, batch["part"][0].as_py()
                first_key = last_key = keys[0].as_py()
            starts = np.flatnonzero(_changes(keys, last_key))
            if len(starts) == 0:
                runs.append(ts)
                continue
            runs.append(ts[: starts[0]])
            if not rows:  # the leading key ends here
                if len(runs) and sum(map(len, runs)):
                    close(leads=True, closes=False)
            runs = [ts[starts[-1] :]]
            last_key = keys[int(starts[-1])].as_py()
        if started:
            close(leads=not rows, closes=True)
        if rows:
            yield from pa.Table.from_pylist(rows, schema=_REPORT_SCHEMA).to_batches()

    return run


_REPORT_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("key", pa.string()),
        ("leads", pa.bool_()),
        ("closes", pa.bool_()),
        ("rows", pa.int64()),
        ("last_ts", pa.int64()),
        ("head_ts", pa.list_(pa.int64())),
        ("exit_ts", pa.list_(pa.int64())),
        ("exit_count", pa.list_(pa.int64())),
    ]
)

VERDICT = "part int, skip bigint, final_count bigint, final_ts bigint"


def _follow(window: int, most: int):
    """Walk each key's reports from left to right; groups that cross a partition end are settled here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_group = None, None  # (part it began in, begun at, events so far, last event)
        verdicts: list[tuple] = []

        def settle() -> None:
            if open_group is not None:
                verdicts.append((open_group[0], None, open_group[2], open_group[3]))

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.key != key:
                    settle()
                    key, open_group = row.key, None
                if not row.leads or open_group is None:
                    if row.closes and row.exit_count[0] > 0:
                        open_group = (row.part, int(row.exit_ts[0]), int(row.exit_count[0]), int(row.last_ts))
                    continue
                origin, begun, count, last = open_group
                head = np.asarray(row.head_ts)
                taken = int(min(np.searchsorted(head, begun + window, side="left"), most - count))
                if taken >= row.rows:  # the whole partition belongs to the carried group
                    total = count + int(row.rows)
                    verdicts.append((row.part, int(row.rows), None, None))
                    open_group = (origin, begun, total, int(row.last_ts))
                    if total == most or not row.closes:
                        settle()
                        open_group = None
                    continue
                verdicts.append((row.part, taken, None, None))
                open_group = (origin, begun, count + taken, int(head[taken - 1]) if taken else last)
                settle()
                left = int(row.exit_count[taken]) if row.closes else 0
                open_group = (row.part, int(row.exit_ts[taken]), left, int(row.last_ts)) if left else None
            if verdicts:
                yield pd.DataFrame(verdicts, columns=["part", "skip", "final_count", "final_ts"])
                verdicts = []
        settle()
        if verdicts:
            yield pd.DataFrame(verdicts, columns=["part", "skip", "final_count", "final_ts"])

    return run


def _emit(window: int, most: int):
    """The groups that begin in a partition, each with its first row, size and last time.

    Every row carries what was settled about its partition: how many rows to skip, and the size and
    last time of the group that is open at its end.
    """
    settled = ("skip", "final_count", "final_ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, skip, final = False, None, 0, (None, None)
        held = None  # (first row as a batch of one, begun at, events so far, last event)

        def group(rows: pa.RecordBatch, counts, lasts) -> pa.RecordBatch:
            names = [name for name in rows.schema.names if name not in ("part", *settled)]
            columns = [rows.column(name) for name in names]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(lasts, pa.int64())], [*names, "count", "last_ts"]
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not started:
                started = True
                skip = batch["skip"][0].as_py() or 0
                final = (batch["final_count"][0].as_py(), batch["final_ts"][0].as_py())
                key = batch["key"][0].as_py()
            if skip:
                cut = min(skip, batch.num_rows)
                batch, skip = batch.slice(cut), skip - cut
                if batch.num_rows == 0:
                    continue
            size = batch.num_rows
            ts = batch["ts"].to_numpy(zero_copy_only=False)
            changed = _changes(batch["key"], key)
            changed_at = int(np.flatnonzero(changed)[0]) if changed.any() else size
            changed[0] = True
            ends = _run_ends(changed, size)
            at = 0
            if held is not None:
                at = int(min(np.searchsorted(ts[:changed_at], held[1] + window, side="left"), most - held[2]))
                count, last = held[2] + at, int(ts[at - 1]) if at else held[3]
                if at < size or count == most:
                    yield group(held[0], [count], [last])
                    held = None
                else:
                    held = (held[0], held[1], count, last)
            following = next_start(ts, ends, window, most).tolist()
            starts = []
            while at < size:
                starts.append(at)
                at = following[at]
            key = batch["key"][size - 1].as_py()
            if not starts:
                continue
            tail = starts[-1]
            if held is None and size - tail < most:  # the last group may go on in the next batch
                starts.pop()
                held = (batch.slice(tail, 1), int(ts[tail]), size - tail, int(ts[-1]))
            if starts:
                picked = np.array(starts)
                stops = np.array([following[i] for i in starts])
                yield group(batch.take(pa.array(picked)), stops - picked, ts[stops - 1])
        if held is not None:
            count, last = (held[2], held[3]) if final[0] is None else final
            yield group(held[0], [count], [last])

    return run


def reduce_groups(
    df: DataFrame, key: str, ts: str, window_ms: int, max_events: int, order: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """The first row of each group with its ``count``, ``first_ts`` and ``last_ts`` in epoch milliseconds.

    ``order`` settles rows of one key at the same time; give an id, so that these can be split too.
    All groups still open at the end of the input are closed there. Rows without a time are groups of
    their own, with null times.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ties = [c for c in (order or [c for c in df.columns if c not in (key, ts)])]
    rest = [c for c in df.columns if c not in (key, "key", "ts")]
    rows = df.select(F.col(key).alias("key"), epoch_ms(df, ts).alias("ts"), *rest)
    ties = [c for c in ties if c in rest]
    places = ["key", "ts", *ties]
    ranged = rows.repartitionByRange(partitions, *places) if partitions else rows.repartitionByRange(*places)
    ordered = ranged.sortWithinPartitions(*places).withColumn("part", F.spark_partition_id()).checkpoint()
    untimed, ordered = ordered.where("ts IS NULL"), ordered.where("ts IS NOT NULL")
    reports = ordered.select("part", "key", "ts").mapInArrow(_report(window_ms, max_events), REPORT)
    followed = reports.repartition("key").sortWithinPartitions("key", "part", F.desc("leads"))
    # One row per partition of the input.
    verdicts = followed.mapInPandas(_follow(window_ms, max_events), VERDICT).groupBy("part").agg(
        *(F.max(c).alias(c) for c in ("skip", "final_count", "final_ts"))
    )
    fields = [f for f in ordered.schema.fields if f.name != "part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", count bigint, last_ts bigint"
    told = ordered.join(F.broadcast(verdicts), "part", "left")  # keeps the order of the rows
    groups = told.mapInArrow(_emit(window_ms, max_events), schema)
    alone = untimed.drop("part").withColumns({"count": F.lit(1).cast("bigint"), "last_ts": F.lit(None).cast("bigint")})
    return groups.unionByName(alone).withColumnRenamed("ts", "first_ts")


def with_reduction(df: DataFrame, min_events: int, message: str = "message") -> DataFrame:
    """Write a group's size and span into its message; small groups pass unchanged.

    JSON objects get two fields, other messages a suffix.
    """
    parsed = with_document(df, F.col(message))
    as_object = F.try_variant_get("_doc", '$["doc"]', "map<string,variant>")
    span = F.col("last_ts") - F.col("first_ts")
    added = F.create_map(
        F.lit("_reduced_count"), F.col("count").cast("variant"), F.lit("_reduced_span_ms"), span.cast("variant")
    )
    # Only groups that are rewritten need their message taken apart.
    wanted = F.col("count") >= min_events
    marked = with_object(parsed, "_reduced", {"message": F.when(wanted, as_object), "added": F.when(wanted, added)})
    suffix = F.concat(F.col(message), F.lit(" [_reduced_count="), F.col("count").cast("string"), F.lit("]"))
    reduced = F.when(as_object.isNotNull(), F.col("_reduced")).otherwise(suffix)
    return marked.withColumn(message, F.when(wanted, reduced).otherwise(F.col(message))).drop("_doc", "_reduced")


def reduce_messages(
    df: DataFrame, config: ReduceConfig, message: str = "message", ts: str = "timestamp",
    order: tuple[str, ...] = (), observe: Observation | None = None,
) -> DataFrame:
    """One message per group, in the form of the first; ``observe`` collects events, groups and the reduction."""
    kept = [message, ts, *[c for c in order if c not in (message, ts)]]
    keyed = reduce_key(df.select(*kept), config.group_by, message, "_key")
    groups = reduce_groups(keyed, "_key", ts, config.window_ms, config.max_events, tuple(order))
    if observe is not None:
        events, made = F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))
        groups = groups.observe(
            observe,
            events.alias("events"),
            made.alias("groups"),
            F.coalesce(1 - made / events, F.lit(0.0)).alias("reduction"),
        )
    return with_reduction(groups, config.min_events, message)
