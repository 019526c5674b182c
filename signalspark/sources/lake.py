"""Reading the tables back: one workspace at a time, by partition."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalspark.functions.ranges import DAY_OF, Range
from signalspark.operators.tables import oldest_kept
from signalspark.schema import TABLES, TIME_COLUMNS
from signalspark.sinks.compact import live, replaced

# Other names under which a table is known.
ALIASES = {"user_traits_v1": "user_traits"}


def _read(spark: SparkSession, root: str, path: str, schema: StructType | None) -> DataFrame | None:
    reader = spark.read.option("basePath", root)
    try:
        return (reader if schema is None else reader.schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _open(spark: SparkSession, base: str, table: str, below: str = "", schema: StructType | None = None):
    """A table, or some of its folders; None without data. The day column names the time it belongs to."""
    name = ALIASES.get(table, table)
    root = f"{base.rstrip('/')}/{name}"
    df = _read(spark, root, root + below, schema)
    if df is None or "date" not in df.columns:
        return df
    if "batch_id" in df.columns:
        df = live(df, replaced(spark, root, below))
    return df.withMetadata("date", {DAY_OF: TIME_COLUMNS.get(name, "timestamp")})


def scan_table(
    spark: SparkSession, base: str, workspace: int, table: str, period: Range | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """A table's rows of one workspace, as a lazy scan of that workspace's folders only.

    period: list no more than the folders of its days, and keep no other rows. schema: of the files,
    folder columns included; without it one file's footer is read.
    """
    below = f"/workspace_id={workspace}"
    days = "" if period is None else "/date={" + ",".join(map(str, period.dates())) + "}"
    df = _open(spark, base, table, below + days, schema)
    if df is None:  # no such folder: the empty part of the table, if there is one
        df = _open(spark, base, table, "", schema)
        if df is None:
            raise FileNotFoundError(f"no data for table {table!r} under {base}")
    df = df.where(F.col("workspace_id") == workspace)
    return df if period is None else df.where(period.predicate(df, TIME_COLUMNS.get(table, "timestamp")))


def expire(spark: SparkSession, base: str, table: str, now: datetime) -> int:
    """Remove the day folders that lie wholly before a table's retention; returns how many."""
    oldest = oldest_kept(table, now)
    if oldest is None:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{table}/workspace_id=*/date=*")
    store = pattern.getFileSystem(conf)
    gone = 0
    for found in store.globStatus(pattern) or []:
        day = found.getPath().getName().removeprefix("date=")
        if day[:4].isdigit() and date.fromisoformat(day) < oldest.date() - timedelta(days=1):
            gone += bool(store.delete(found.getPath(), True))
    return gone


def open_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Every table that has data; each one's files are listed once."""
    opened = {table: _open(spark, base, table) for table in TABLES}
    return {table: df for table, df in opened.items() if df is not None}


def register_tables(spark: SparkSession, base: str, workspace: int) -> list[str]:
    """Temp views for every table that has data, scoped to the workspace; the rest is skipped."""
    found = open_tables(spark, base)
    if not found:
        raise FileNotFoundError(f"no tables under {base}")
    names = {name: name for name in found} | {alias: t for alias, t in ALIASES.items() if t in found}
    for name, table in names.items():
        found[table].where(F.col("workspace_id") == workspace).createOrReplaceTempView(name)
    return list(found)


def list_tables(spark: SparkSession, base: str) -> dict[str, list[tuple[str, str]]]:
    """Every table that has data, with its columns and types."""
    return {
        table: [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        for table, df in open_tables(spark, base).items()
    }
