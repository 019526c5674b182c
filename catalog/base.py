"""Registry, and views that dress the test tables as events, context, logs and users."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.schema import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with its SQL counterpart if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = WITH_VIEWS + oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The same column text runs in Spark and in DuckDB.
_SESSION = "concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id"
_EVENTS = [
    "event_id",
    "ts AS timestamp",
    "event_type AS event_name",
    "CAST(user_id AS STRING) AS device_id",
    _SESSION,
    "concat('::ffff:10.0.', CAST(user_id % 256 AS STRING), '.1') AS source_ip",
    "props AS properties",
    "value",
    "user_id % 3 + 1 AS workspace_id",
]
_VISITS = ["user_id", "CAST(ts AS DATE) AS day", "ts"]
_CONTEXT = [
    "first_ts AS timestamp",
    "CAST(user_id AS STRING) AS device_id",
    "concat(CAST(user_id AS STRING), '-', CAST(day AS STRING)) AS session_id",
    "CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type",
    "CASE user_id % 4 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' WHEN 2 THEN 'Windows' ELSE 'macOS' END"
    " AS operating_system",
    "n_name AS country",
]
_LOGS = [
    "event_id",
    "ts AS timestamp",
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE' WHEN 'purchase' THEN 'INFO'"
    " WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS level",
    "concat('web-', CAST(user_id % 4 AS STRING)) AS source",
    "concat('svc-', CAST(user_id % 7 AS STRING)) AS service",
    _SESSION,
    "concat('User ', CAST(user_id AS STRING), ' did ', event_type, ' from 10.0.',"
    " CAST(user_id % 256 AS STRING), '.1 request ', CAST(event_id AS STRING)) AS message",
]
_USERS = [
    "concat('user', CAST(c_custkey AS STRING), '@example.com') AS email",
    "c_name AS name",
    "c_custkey",
    "TIMESTAMP_NTZ '2024-01-15 00:00:00' AS updated_at",
]
# One JSON message per event, with a nested object, a number, a text number, a flag and a null.
_MESSAGES = [
    "event_id",
    "ts",
    "concat('{\"level\":\"', event_type, '\",\"user\":{\"id\":', CAST(user_id AS STRING),"
    " ',\"tier\":\"t', CAST(user_id % 5 AS STRING), '\"},\"amount\":',"
    " CAST(CAST(value AS DECIMAL(18,2)) AS STRING), ',\"size\":\"', CAST(event_id % 100 AS STRING),"
    " '\",\"ok\":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,"
    " CASE WHEN event_id % 3 = 0 THEN ',\"note\":null' WHEN event_id % 3 = 1 THEN"
    " concat(',\"note\":\"n', CAST(event_id % 10 AS STRING), '\"') ELSE '' END, ',\"props\":', props, '}')"
    " AS message",
]


def events(spark, sf):
    return table(spark, sf, "events").selectExpr(*_EVENTS)


def context(spark, sf):
    """One context row per device and day; grouping comes before the nation lookup."""
    visits = table(spark, sf, "events").selectExpr(*_VISITS).groupBy("user_id", "day").agg(
        F.min("ts").alias("first_ts")
    )
    nation = table(spark, sf, "nation")
    return visits.join(nation, nation.n_nationkey == F.col("user_id") % 25).selectExpr(*_CONTEXT)


def logs(spark, sf):
    return table(spark, sf, "events").selectExpr(*_LOGS)


def users(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_USERS)


def messages(spark, sf):
    return table(spark, sf, "events").selectExpr(*_MESSAGES)


def frames(spark, sf) -> Frames:
    openers = {"events": events, "context": context, "logs": logs, "users": users}
    return Frames(**{name: cache(partial(opener, spark, sf)) for name, opener in openers.items()})


WITH_VIEWS = f"""WITH v_events AS (SELECT {", ".join(_EVENTS)} FROM events),
v_visits AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_ts FROM events GROUP BY 1, 2),
v_context AS (SELECT {", ".join(_CONTEXT)} FROM v_visits JOIN nation ON n_nationkey = user_id % 25),
v_logs AS (SELECT {", ".join(_LOGS)} FROM events),
v_users AS (SELECT {", ".join(_USERS).replace("TIMESTAMP_NTZ", "TIMESTAMP")} FROM customer),
v_messages AS (SELECT {", ".join(_MESSAGES)} FROM events)
"""

RANGE = "2024-01-01,2024-01-30"
LATER = "2024-01-16,2024-01-30"
IN_RANGE = "timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp <= TIMESTAMP '2024-01-30 23:59:59'"
IN_LATER = "timestamp >= TIMESTAMP '2024-01-16 00:00:00' AND timestamp <= TIMESTAMP '2024-01-30 23:59:59'"
IN_EARLIER = "timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp <= TIMESTAMP '2024-01-15 23:59:59'"
