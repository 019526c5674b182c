"""Writers: partitioned Parquet, the typed tables, text lines, console, none, and JDBC."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.normalize import norm_ip
from signalspark.operators import tables
from signalspark.schema import TIME_COLUMNS
from signalspark.sinks.compact import filters_of

# Accepted codec names, and column order of file rows (filters first, payload last).
CODECS = {"snappy": "snappy", "lz4": "lz4", "zstd": "zstd", "none": "uncompressed"}
EVENT_COLUMNS = [
    "timestamp",
    "batch_timestamp",
    "workspace_id",
    "event_type",
    "event_name",
    "device_id",
    "session_id",
    "source_ip",
    "payload",
]
LOG_COLUMNS = [
    "timestamp",
    "batch_timestamp",
    "workspace_id",
    "level",
    "event_type",
    "source",
    "service",
    "session_id",
    "source_ip",
    "payload",
]


def with_workspace(df: DataFrame) -> DataFrame:
    """Rows that belong to a workspace."""
    return df.where(F.col("workspace_id").isNotNull() & (F.col("workspace_id") != 0))


def _stamped(df: DataFrame, now: datetime | None) -> DataFrame:
    if "batch_timestamp" in df.columns:
        return df
    moment = F.current_timestamp() if now is None else F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f UTC")).cast("timestamp")
    return df.withColumn("batch_timestamp", moment)


def _ordered(df: DataFrame) -> DataFrame:
    known = EVENT_COLUMNS if "event_name" in df.columns else LOG_COLUMNS
    front = [c for c in known if c in df.columns and c != "payload"]
    rest = [c for c in df.columns if c not in front and c != "payload"]
    return df.select(*front, *rest, *[c for c in ("payload",) if c in df.columns])


def write_parquet(
    df: DataFrame,
    path: str,
    rotation: str = "hourly",
    codec: str = "snappy",
    mode: str = "append",
    now: datetime | None = None,
    batch: str | None = None,
) -> None:
    """Files under workspace / date / hour of receipt.

    batch: a name for the batch, which becomes one more folder; writing it again replaces its own rows.
    The rebalance hint gathers each folder's rows into few files and lets AQE split a folder
    that is much larger than the others; sorting by time narrows the row-group statistics.
    """
    if rotation not in ("hourly", "daily"):
        raise ValueError(f"unknown rotation {rotation!r}")
    stamped = _ordered(_stamped(with_workspace(df), now)).withColumn("date", F.to_date("batch_timestamp"))
    folders = ["workspace_id", "date"]
    if rotation == "hourly":
        stamped = stamped.withColumn("hour", F.date_format("batch_timestamp", "HH"))
        folders.append("hour")
    if batch is not None:
        stamped, mode = stamped.withColumn("batch_id", F.lit(batch)), "overwrite"
        folders.append("batch_id")
    (
        stamped.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", CODECS[codec])
        .partitionBy(*folders)
        .parquet(path)
    )


def write_table(df: DataFrame, base: str, table: str, batch: str | None = None) -> None:
    """Add one batch's rows to a table, under workspace, day and batch.

    batch: a name for the batch. Writing a batch again replaces its own folders and no others, so a
    stream's retries leave one copy; without a name every write is a batch of its own. ``sinks.compact``
    merges the batches of closed days. Columns by which rows are looked up get Bloom filters.
    """
    ts = TIME_COLUMNS.get(table, "timestamp")
    folders = ["workspace_id", "date"]
    (
        with_workspace(df)
        .withColumns({"date": F.to_date(ts), "batch_id": F.lit(batch or uuid.uuid4().hex)})
        .hint("rebalance", *folders)
        .sortWithinPartitions(*folders, ts)
        .write.options(**filters_of(df.columns))
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders, "batch_id")
        .parquet(f"{base.rstrip('/')}/{table}")
    )


def write_tables(
    base: str, events: DataFrame | None = None, logs: DataFrame | None = None,
    snapshots: DataFrame | None = None, batch: str | None = None,
) -> None:
    """Fan one batch out into the seven typed tables; the input is computed once and kept meanwhile."""
    batch = batch or uuid.uuid4().hex
    if events is not None:
        kept = events.persist(StorageLevel.MEMORY_AND_DISK)
        found = tables.identified(kept).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for table, build in tables.EVENT_TABLES.items():
                shared = tables.IDENTIFIED_TABLES.get(table)
                write_table(build(kept) if shared is None else shared(found), base, table, batch)
        finally:
            found.unpersist()
            kept.unpersist()
    if logs is not None:
        write_table(tables.to_logs(logs), base, "logs_v1", batch)
    if snapshots is not None:
        write_table(snapshots, base, "snapshots_v1", batch)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch's rows to a folder; writing the batch again replaces its own."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def stream_batch(batch: DataFrame, batch_id: int) -> str:
    """A name for a stream's micro-batch that its retries share and no other query's batch has."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'batch'}-{batch_id}"


def escape_text(col: Column) -> Column:
    """Line breaks, tabs, backslashes and other control characters spelled out."""
    result = col
    for plain, spelled in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        result = F.replace(result, F.lit(plain), F.lit(spelled))

    def spell(char: Column) -> Column:
        code = F.lower(F.lpad(F.hex(F.ascii(char)), 2, "0"))
        return F.when(char.rlike(r"^\p{Cc}$"), F.concat(F.lit("\\x"), code)).otherwise(char)

    spelled = F.array_join(F.transform(F.split(result, ""), spell), "")
    return F.when(result.rlike(r"\p{Cc}"), spelled).otherwise(result)


def _moment(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _or_dash(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("-"))


def event_line(now_column: str = "batch_timestamp") -> Column:
    return F.format_string(
        "[%s] [%s] device_id=%s session_id=%s event_name=%s timestamp=%s source_ip=%s payload=%s",
        _moment(now_column),
        F.upper("event_type"),
        _or_dash("device_id"),
        _or_dash("session_id"),
        _or_dash("event_name"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string"),
        F.coalesce(norm_ip(F.col("source_ip")), F.lit("-")),
        escape_text(F.coalesce("payload", F.lit(""))),
    )


def log_line(now_column: str = "batch_timestamp") -> Column:
    return F.format_string(
        "[%s] [%s] session_id=%s source=%s service=%s timestamp=%s source_ip=%s payload=%s",
        _moment(now_column),
        F.upper("level"),
        _or_dash("session_id"),
        _or_dash("source"),
        _or_dash("service"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string"),
        F.coalesce(norm_ip(F.col("source_ip")), F.lit("-")),
        escape_text(F.coalesce("payload", F.lit(""))),
    )


def text_lines(df: DataFrame, kind: str, now: datetime | None = None) -> DataFrame:
    """Rows as printable lines with their workspace and day of receipt."""
    line = {"events": event_line, "logs": log_line}[kind]()
    stamped = _stamped(with_workspace(df), now)
    return stamped.select("workspace_id", F.to_date("batch_timestamp").alias("date"), line.alias("value"))


def write_text(
    df: DataFrame, path: str, kind: str = "events", codec: str = "none", mode: str = "append",
    now: datetime | None = None,
) -> None:
    """Text files per kind, workspace and day."""
    lines = text_lines(df, kind, now).hint("rebalance", "workspace_id", "date")
    lines.write.mode(mode).option("compression", codec).partitionBy("workspace_id", "date").text(f"{path}/{kind}")


def write_console(df: DataFrame, rows: int = 20):
    """Print rows; on a stream, start printing each micro-batch."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).option("truncate", False).start()
    return df.show(rows, truncate=False)


def write_noop(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def retrying(write: Callable[[DataFrame, int], None], attempts: int = 3, delay: float = 0.1):
    """A foreachBatch function that tries a failing write again, waiting longer each time."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(attempts):
            try:
                return write(batch, batch_id)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(delay * 2**attempt)

    return run


def jdbc_writer(
    options: dict[str, str], attempts: int = 3, clear: Callable[[str], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each micro-batch to a database table.

    Every row gets the batch's name as ``batch_id``. clear: called with that name before each
    attempt, to delete what an earlier attempt at the same batch left; without it a retry after a
    partly done write repeats rows, which readers can tell by key and ``batch_id``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = stream_batch(batch, batch_id)
        if clear is not None:
            clear(name)
        batch.withColumn("batch_id", F.lit(name)).write.format("jdbc").options(**options).mode("append").save()

    return retrying(write, attempts)
