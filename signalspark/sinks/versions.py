"""Whole states of a table in one folder, one after another; readers see the last complete one.

A state is written under a name of its attempt and renamed when it is complete, so that it can be made
from the one that readers see meanwhile. Its name holds its number and the batch it belongs to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX, _DIGITS = "state-", 12


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def states(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Number and batch of the complete states, oldest first."""
    path, store = _store(spark, folder)
    if not store.exists(path):
        return []
    names = [found.getPath().getName() for found in store.listStatus(path)]
    split = [name.removeprefix(_PREFIX).split("-", 1) for name in names if name.startswith(_PREFIX)]
    return sorted((int(number), batch) for number, batch in split)


def _name(state: tuple[int, str]) -> str:
    return f"{_PREFIX}{state[0]:0{_DIGITS}d}-{state[1]}"


def read_state(spark: SparkSession, folder: str, state: tuple[int, str] | None = None) -> DataFrame | None:
    """A state, by default the last one; None if there is none."""
    if state is None:
        found = states(spark, folder)
        if not found:
            return None
        state = found[-1]
    return spark.read.parquet(f"{folder.rstrip('/')}/{_name(state)}")


def before(spark: SparkSession, folder: str, batch: str) -> tuple[int, str] | None:
    """The state that a batch starts from: the one before its own if it was written already, else the last."""
    found = states(spark, folder)
    known = [i for i, (_, name) in enumerate(found) if name == batch]
    found = found[: known[0]] if known else found
    return found[-1] if found else None


def write_state(df: DataFrame, folder: str, batch: str | None = None, keep: int = 3) -> tuple[int, str]:
    """Add a state; a batch that has one leaves it as it is. All but the last ``keep`` are removed.

    A batch may be repeated as long as the state before its own is kept, so keep two at least.
    """
    if keep < 2:
        raise ValueError("keep must be at least 2")
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    found = states(spark, folder)
    for state in found:
        if state[1] == batch:
            return state
    made = (found[-1][0] + 1 if found else 0, batch)
    attempt, root = f"{folder.rstrip('/')}/_attempt-{uuid.uuid4().hex}", folder.rstrip("/")
    df.write.parquet(attempt)
    source, store = _store(spark, attempt)
    target = _store(spark, f"{root}/{_name(made)}")[0]
    if not store.rename(source, target):
        raise OSError(f"could not rename {attempt} to {_name(made)}")
    for state in [*found, made][:-keep]:
        store.delete(_store(spark, f"{root}/{_name(state)}")[0], True)
    return made
