"""Table names, column schemas and fixed values of the data model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NIL_UUID = "00000000-0000-0000-0000-000000000000"

# The typed tables, in load order.
TABLES = [
    "events_v1",
    "context_v1",
    "users_v1",
    "user_devices",
    "user_traits",
    "logs_v1",
    "snapshots_v1",
    "pattern_registry",
    "pattern_groups",
]

# The column that holds a table's own time, where it is not ``timestamp``.
TIME_COLUMNS = {
    "users_v1": "updated_at",
    "user_devices": "linked_at",
    "user_traits": "updated_at",
    "pattern_registry": "last_updated",
}

# Storage severities by level name (RFC 5424 order, then TRACE).
SEVERITY = {
    "EMERGENCY": 0,
    "FATAL": 0,
    "ALERT": 1,
    "CRITICAL": 2,
    "CRIT": 2,
    "ERROR": 3,
    "ERR": 3,
    "WARNING": 4,
    "WARN": 4,
    "NOTICE": 5,
    "INFO": 6,
    "DEBUG": 7,
    "TRACE": 8,
}
DEFAULT_SEVERITY = 6

# How long each table keeps its rows, in years.
RETENTION_YEARS = {"events_v1": 5, "context_v1": 5, "snapshots_v1": 5, "logs_v1": 2}

# Event types that are stored, and those that are accepted but not stored.
EVENT_TYPES = ["track", "identify", "group", "alias", "enrich", "context"]
UNSTORED_TYPES = ["group", "alias", "enrich", "unknown"]

# Payload fields lifted into the context table.
CONTEXT_FIELDS = [
    "device_type",
    "device_model",
    "operating_system",
    "os_version",
    "app_version",
    "app_build",
    "timezone",
    "locale",
    "country",
    "region",
    "city",
]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField(
            "labels",
            T.ArrayType(
                T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
        T.StructField("temporality", T.StringType()),
        T.StructField(
            "histogram",
            T.StructType(
                [
                    T.StructField("count", T.LongType()),
                    T.StructField("sum", T.DoubleType()),
                    T.StructField("min", T.DoubleType()),
                    T.StructField("max", T.DoubleType()),
                    T.StructField(
                        "buckets",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("upper_bound", T.DoubleType()),
                                    T.StructField("count", T.LongType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("duration_ns", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


Table = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Frames:
    """The analytics tables a metric may read; any may be absent, or a function that opens it when used."""

    events: Table | None = None
    context: Table | None = None
    logs: Table | None = None
    users: Table | None = None
    user_devices: Table | None = None
    user_traits: Table | None = None
    snapshots: Table | None = None

    def find(self, name: str) -> DataFrame | None:
        table = getattr(self, name)
        return table() if callable(table) else table

    def get(self, name: str) -> DataFrame:
        table = self.find(name) if name in {f.name for f in fields(self)} else None
        if table is None:
            raise ValueError(f"no table named {name!r} in these frames")
        return table
