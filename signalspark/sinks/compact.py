"""Compaction of a table's closed days: many batch folders of a day become one.

The merged folder is written aside, together with a list of the batches it stands for, and renamed into
the day. Readers leave out the batches that some merged folder of the day stands for, so one rename
moves them from the old folders to the new one. The old folders go after that.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.schema import TIME_COLUMNS

MERGED = "merged-"
#: Spark's readers do not look at names that begin with an underscore.
_LIST = "_replaces"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, pattern: str) -> list[tuple[int, str, str]]:
    """Workspace, day and batch of the batch folders that match."""
    path, store = _hadoop(spark, pattern)
    out = []
    for found in store.globStatus(path) or []:
        parts = [part.split("=", 1)[1] for part in found.getPath().toString().rstrip("/").split("/")[-3:]]
        out.append((int(parts[0]), parts[1], parts[2]))
    return sorted(out)


def replaced(spark: SparkSession, root: str, below: str = "") -> list[tuple[int, str, str, list[str]]]:
    """Merged folders below a table's folder whose old folders may still be there: workspace, day, the merged
    batch and those that it stands for."""
    levels = [part for part in below.split("/") if part]
    pattern = "/".join([root, *levels, *("workspace_id=*", "date=*")[len(levels) :], f"batch_id={MERGED}*", _LIST])
    path, store = _hadoop(spark, pattern)
    out = []
    for found in store.globStatus(path) or []:
        workspace, day, merged = (part.split("=", 1)[1] for part in found.getPath().toString().split("/")[-4:-1])
        lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(store.open(found.getPath()), "UTF-8")
        out.append((int(workspace), day, merged, json.loads(lines)))
    return out


def live(df: DataFrame, gone: list[tuple[int, str, str, list[str]]]) -> DataFrame:
    """A table's rows without those of batches that a merged folder stands for.

    gone: looked up after the frame was opened. What counts are the merged folders that the frame itself
    has listed: a folder that was renamed since is not in it, and what it stands for still is.
    """
    if not gone:
        return df
    listed = {part for name in df.inputFiles() for part in name.split("/") if part.startswith(f"batch_id={MERGED}")}
    test: Column | None = None
    for workspace, day, merged, batches in gone:
        if f"batch_id={merged}" not in listed:
            continue
        here = (F.col("workspace_id") == workspace) & (F.col("date") == F.lit(day).cast("date"))
        here &= F.col("batch_id").isin(batches)
        test = here if test is None else test | here
    return df if test is None else df.where(~test)


def compact_day(spark: SparkSession, base: str, table: str, workspace: int, day: date) -> int:
    """Merge the batches that a day holds now; returns how many folders went. Rows keep their order in time.

    A run that broke off is finished by the next one; a batch that comes meanwhile stays by itself.
    """
    root = f"{base.rstrip('/')}/{table}"
    folder = f"{root}/workspace_id={workspace}/date={day}"
    gone = {b for *_, batches in replaced(spark, root, f"/workspace_id={workspace}/date={day}") for b in batches}
    found = [b for _, _, b in _folders(spark, f"{folder}/batch_id=*")]
    waiting = [b for b in found if b not in gone]
    if len(waiting) > 1:
        ts = TIME_COLUMNS.get(table, "timestamp")
        rows = spark.read.option("mergeSchema", "true").parquet(*(f"{folder}/batch_id={b}" for b in waiting))
        attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
        rows.hint("rebalance").sortWithinPartitions(ts).write.options(**filters_of(rows.columns)).parquet(attempt)
        listed, store = _hadoop(spark, f"{attempt}/{_LIST}")
        out = store.create(listed, True)
        out.write(bytearray(json.dumps(waiting).encode()))
        out.close()
        merged = f"{folder}/batch_id={MERGED}{uuid.uuid4().hex}"
        if not store.rename(_hadoop(spark, attempt)[0], _hadoop(spark, merged)[0]):
            raise OSError(f"could not rename {attempt} to {merged}")
        gone |= set(waiting)
    dropped = 0
    for batch in gone & set(found):
        path, store = _hadoop(spark, f"{folder}/batch_id={batch}")
        dropped += bool(store.delete(path, True))
    # Nothing is left that a list would hide.
    path, store = _hadoop(spark, f"{folder}/batch_id={MERGED}*/{_LIST}")
    for status in store.globStatus(path) or []:
        store.delete(status.getPath(), False)
    return dropped


def compact_closed(spark: SparkSession, base: str, table: str, now: datetime) -> int:
    """Merge every day before that of ``now``, in UTC, that has several batches; returns how many folders went."""
    found = _folders(spark, f"{base.rstrip('/')}/{table}/workspace_id=*/date=*/batch_id=*")
    days: dict[tuple[int, str], int] = {}
    for workspace, day, _ in found:
        days[workspace, day] = days.get((workspace, day), 0) + 1
    return sum(
        compact_day(spark, base, table, workspace, date.fromisoformat(day))
        for (workspace, day), n in days.items()
        if n > 1 and day[:4].isdigit() and date.fromisoformat(day) < now.date()
    )


#: Columns by which single rows are looked up; Parquet keeps a Bloom filter of each in every row group.
LOOKED_UP = ("session_id", "device_id", "source_ip")


def filters_of(columns: list[str]) -> dict[str, str]:
    """Writer options for Bloom filters of the columns among these by which rows are looked up."""
    options = {}
    for name in LOOKED_UP:
        if name in columns:
            options[f"parquet.bloom.filter.enabled#{name}"] = "true"
            options[f"parquet.bloom.filter.adaptive.enabled#{name}"] = "true"
    return options
