"""Ingest, normalisation, typed tables, routing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import IN_LATER, LATER, context, events, frames, logs, query, table, users
from signalspark.functions import normalize as n
from signalspark.functions.filters import Filter
from signalspark.functions.jsondoc import json_depth, too_deep
from signalspark.functions.ranges import parse_range
from signalspark.operators import metrics
from signalspark.operators import tables as t
from signalspark.operators.routing import Rule, route
from signalspark.schema import Frames
from signalspark.session import ensure_checkpoint_dir
from signalspark.sinks import files
from signalspark.sources import jsonl, lake

NOW_MS = 1_706_000_000_000

# --- event lines made from the events table; a few of them are broken in known ways

# The same text runs in both engines.
_DEVICE = (
    "concat(lpad(CAST(user_id AS STRING), 8, '0'), '-0000-4000-8000-', lpad(CAST(event_id % 97 AS STRING), 12, '0'))"
)
_KIND = (
    "CASE event_id % 10 WHEN 0 THEN 'identify' WHEN 1 THEN 'context' WHEN 2 THEN 'group' WHEN 3 THEN 'Mystery'"
    " ELSE 'Track' END"
)
_BODY = """CASE event_id % 10
    WHEN 0 THEN concat(',"user_id":"u', CAST(user_id AS STRING), '","properties":{"email":" User',
        CAST(user_id AS STRING), '@Example.com"},"traits":{"plan":"p', CAST(event_id % 3 AS STRING),
        '","seats":', CAST(event_id % 7 AS STRING), '}')
    WHEN 1 THEN concat(',"properties":{"device_type":"mobile","country":"c', CAST(user_id % 25 AS STRING),
        '","locale":"en"}')
    ELSE concat(',"properties":', props, ',"group_id":"g', CAST(user_id % 9 AS STRING), '"') END"""
_EVENT_LINE = f"""CASE event_id % 50
    WHEN 14 THEN '{{"type":"track",'
    WHEN 15 THEN concat('{{"type":"track","event":"', event_type, '"}}')
    WHEN 16 THEN '{{"type":"track","device_id":"not-a-uuid"}}'
    WHEN 17 THEN '   '
    ELSE concat('{{"type":"', {_KIND}, '","event":"', event_type, '","device_id":"', {_DEVICE},
        '","timestamp":', CAST(1704067200000 + event_id * 1000 AS STRING), {_BODY}, '}}') END"""
_EVENT_OK = "event_id % 50 NOT IN (14, 15, 16, 17)"
_STAMP = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id)"
_PAYLOAD = """CASE event_id % 10
    WHEN 0 THEN concat('{"email":" User', CAST(user_id AS STRING), '@Example.com","plan":"p',
        CAST(event_id % 3 AS STRING), '","seats":', CAST(event_id % 7 AS STRING), ',"user_id":"u',
        CAST(user_id AS STRING), '"}')
    WHEN 1 THEN concat('{"country":"c', CAST(user_id % 25 AS STRING), '","device_type":"mobile","locale":"en"}')
    ELSE concat('{"group_id":"g', CAST(user_id % 9 AS STRING), '","k":', json_extract_string(props, '$.k'), '}')
    END"""
_NIL = "'00000000-0000-0000-0000-000000000000'"


def event_lines(spark, sf):
    return table(spark, sf, "events").selectExpr(
        f"{_EVENT_LINE} AS value", "concat('192.168.0.', CAST(user_id % 200 AS STRING)) AS source_ip"
    )


def ingested(spark, sf):
    return jsonl.parse_event_lines(event_lines(spark, sf), NOW_MS)[0]


def _plain_time(df, *names):
    for name in names or ["timestamp"]:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


_IP = "concat('::ffff:192.168.0.', CAST(user_id % 200 AS STRING))"


@query(
    "s1_events_jsonl",
    f"""SELECT CASE {_KIND} WHEN 'Mystery' THEN 'unknown' ELSE lower({_KIND}) END AS event_type,
        {_STAMP} AS timestamp, {_DEVICE} AS device_id, CAST(NULL AS VARCHAR) AS session_id,
        event_type AS event_name, {_PAYLOAD} AS payload FROM events WHERE {_EVENT_OK}""",
)
def _(spark, sf):
    return _plain_time(ingested(spark, sf)).drop("traits", "source_ip")


@query(
    "s1_events_jsonl_rejected",
    """SELECT CASE event_id % 50 WHEN 14 THEN '{"type":"track",'
            WHEN 15 THEN concat('{"type":"track","event":"', event_type, '"}')
            ELSE '{"type":"track","device_id":"not-a-uuid"}' END AS line,
        CASE event_id % 50 WHEN 14 THEN 'invalid JSON' WHEN 15 THEN 'missing field `device_id`'
            ELSE '`device_id` must be a valid UUID' END AS error
        FROM events WHERE event_id % 50 IN (14, 15, 16)""",
)
def _(spark, sf):
    return jsonl.parse_event_lines(event_lines(spark, sf), NOW_MS)[1].drop("source_ip")


_LOG_LEVEL = (
    "CASE event_id % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'warn' WHEN 2 THEN 'NOTICE' WHEN 3 THEN 'err'"
    " WHEN 4 THEN 'odd' ELSE 'trace' END"
)
_LOG_LINE = f"""CASE WHEN event_id % 40 = 0 THEN '{{"level":"info"}}'
    WHEN event_id % 40 = 1 THEN '{{"message":"no default level"}}'
    ELSE concat('{{"level":"', {_LOG_LEVEL}, '","message":"m', CAST(event_id AS STRING),
        '","service":"svc-', CAST(user_id % 7 AS STRING), '","timestamp":',
        CAST(1704067200000 + event_id * 1000 AS STRING), ',"data":{{"k":', CAST(event_id % 5 AS STRING),
        CASE WHEN event_id % 3 = 0 THEN ',"message":"replaced"' ELSE '' END, '}}}}') END"""
_STORED_LEVEL = (
    "CASE event_id % 6 WHEN 0 THEN 'fatal' WHEN 1 THEN 'warning' WHEN 2 THEN 'warning' WHEN 3 THEN 'error'"
    " WHEN 4 THEN 'info' ELSE 'trace' END"
)


def log_lines(spark, sf):
    return table(spark, sf, "events").selectExpr(f"{_LOG_LINE} AS value")


@query(
    "s2_logs_jsonl",
    f"""SELECT 'log' AS event_type, {_STORED_LEVEL} AS level, {_STAMP} AS timestamp,
        CAST(NULL AS VARCHAR) AS source, concat('svc-', CAST(user_id % 7 AS VARCHAR)) AS service,
        CAST(NULL AS VARCHAR) AS session_id,
        concat('{{"k":', CAST(event_id % 5 AS VARCHAR), ',"message":"',
            CASE WHEN event_id % 3 = 0 THEN 'replaced' ELSE concat('m', CAST(event_id AS VARCHAR)) END, '"}}') AS payload
        FROM events WHERE event_id % 40 > 1
        UNION ALL SELECT 'log', 'info', TIMESTAMP '2024-01-23 08:53:20', NULL, NULL, NULL,
            '{{"message":"no default level"}}' FROM events WHERE event_id % 40 = 1""",
)
def _(spark, sf):
    return _plain_time(jsonl.parse_log_lines(log_lines(spark, sf), NOW_MS)[0])


@query("s2_logs_jsonl_rejected", "SELECT '{\"level\":\"info\"}' AS line, 'missing field `message`' AS error"
       " FROM events WHERE event_id % 40 = 0")  # fmt: skip
def _(spark, sf):
    return jsonl.parse_log_lines(log_lines(spark, sf), NOW_MS)[1]


_NESTED = (
    "concat(repeat('[', CAST(event_id % 40 AS INT)), '{\"a\":\"}]{[\\\\\"', event_type, '\"}',"
    " repeat(']', CAST(event_id % 40 AS INT))) AS line"
)


@query(
    "s3_json_depth",
    "SELECT event_id, CAST(event_id % 40 + 1 AS INTEGER) AS depth, event_id % 40 + 1 > 32 AS too_deep FROM events",
)
def _(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", _NESTED)
    line = F.col("line")
    return lines.select("event_id", json_depth(line).alias("depth"), too_deep(line, 32).alias("too_deep"))


@query(
    "s5_syslog_text",
    f"""SELECT 'log' AS event_type, 'info' AS level, TIMESTAMP '2024-01-23 08:53:20' AS timestamp, '' AS source,
        '' AS service, {_NIL} AS session_id, message AS payload FROM v_logs""",
)
def _(spark, sf):
    lines = logs(spark, sf).select(F.col("message").alias("value"))
    return _plain_time(jsonl.parse_syslog_lines(lines, NOW_MS)).drop("source_ip")


_SNAPSHOT = (
    "concat('{\"', CASE WHEN s_suppkey % 2 = 0 THEN 'connector' ELSE 'source' END, '\":\"shop\",\"entity\":\"',"
    " CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE s_name END, '\"', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE"
    " concat(',\"metrics\":{\"orders\":', CAST(s_suppkey AS STRING), ',\"nation\":\"n', CAST(s_nationkey AS STRING),"
    " '\"}') END, '}') AS value"
)


@query(
    "s6_snapshots",
    """SELECT TIMESTAMP '2024-01-23 08:53:20' AS timestamp, 'shop' AS connector, s_name AS entity,
        CASE WHEN s_suppkey % 3 = 0 THEN '{}' ELSE concat('{"nation":"n', CAST(s_nationkey AS VARCHAR),
            '","orders":', CAST(s_suppkey AS VARCHAR), '}') END AS metrics
        FROM supplier WHERE s_suppkey % 5 <> 4""",
)
def _(spark, sf):
    return _plain_time(jsonl.parse_snapshots(table(spark, sf, "supplier").selectExpr(_SNAPSHOT), NOW_MS))


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s7_scan_table", "SELECT event_name, device_id, session_id, workspace_id FROM v_events WHERE workspace_id = 2")
def _(spark, sf):
    base = scratch(spark, "lake")
    rows = events(spark, sf).withColumn("payload", F.col("properties"))
    files.write_table(rows, base, "events_v1")
    scanned = lake.scan_table(spark, base, 2, "events_v1")
    return scanned.select("event_name", "device_id", "session_id", F.col("workspace_id").cast("bigint"))


# --- normalisation

_RAW_ID = f"""CASE event_id % 5 WHEN 0 THEN {_DEVICE} WHEN 1 THEN upper(replace({_DEVICE}, '-', ''))
    WHEN 2 THEN concat({_DEVICE}, 'f') WHEN 3 THEN replace({_DEVICE}, '0', 'x') ELSE NULL END"""
_CLEAN_ID = f"CASE WHEN event_id % 5 IN (0, 1) THEN {_DEVICE} END"


def _from(spark, sf, name, *exprs):
    return table(spark, sf, name).selectExpr(*exprs)


@query("n1_uuid", f"SELECT event_id, {_CLEAN_ID} AS id FROM events")
def _(spark, sf):
    return _from(spark, sf, "events", "event_id", f"{_RAW_ID} AS raw").select(
        "event_id", n.norm_uuid(F.col("raw")).alias("id")
    )


@query("n2_nil_uuid", f"SELECT event_id, coalesce({_CLEAN_ID}, {_NIL}) AS id FROM events")
def _(spark, sf):
    return _from(spark, sf, "events", "event_id", f"{_RAW_ID} AS raw").select(
        "event_id", n.nil_uuid(n.norm_uuid(F.col("raw"))).alias("id")
    )


@query(
    "n3_timestamp",
    f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-01-23 08:53:20' ELSE {_STAMP} END AS timestamp"
    " FROM events",
)
def _(spark, sf):
    raw = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1704067200000 + event_id * 1000 END AS ms"
    df = _from(spark, sf, "events", "event_id", raw)
    return _plain_time(df.select("event_id", n.ts_from_ms(F.col("ms"), NOW_MS).alias("timestamp")))


_RAW_KIND = (
    "CASE event_id % 7 WHEN 0 THEN 'TRACK' WHEN 1 THEN 'Identify' WHEN 2 THEN 'group' WHEN 3 THEN 'alias'"
    " WHEN 4 THEN 'Enrich' WHEN 5 THEN 'context' ELSE event_type END"
)


@query(
    "n4_event_type",
    f"SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'unknown' ELSE lower({_RAW_KIND}) END AS event_type FROM events",
)
def _(spark, sf):
    df = _from(spark, sf, "events", "event_id", f"{_RAW_KIND} AS raw")
    return df.select("event_id", n.norm_event_type(F.col("raw")).alias("event_type"))


_RAW_LEVEL = (
    "CASE event_id % 9 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' WHEN 3 THEN 'ERROR'"
    " WHEN 4 THEN 'Warn' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' WHEN 7 THEN 'debug' ELSE 'Trace' END"
)


@query(
    "n5_log_level",
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'fatal' WHEN 1 THEN 'fatal' WHEN 2 THEN 'fatal' WHEN 3 THEN 'error'
        WHEN 4 THEN 'warning' WHEN 5 THEN 'warning' WHEN 6 THEN 'info' WHEN 7 THEN 'debug' ELSE 'trace' END AS level
        FROM events""",
)
def _(spark, sf):
    df = _from(spark, sf, "events", "event_id", f"{_RAW_LEVEL} AS raw")
    return df.select("event_id", n.norm_log_level(F.col("raw")).alias("level"))


@query("n6_severity", "SELECT event_id, CAST(event_id % 9 AS INTEGER) AS severity FROM events")
def _(spark, sf):
    df = _from(spark, sf, "events", "event_id", f"{_RAW_LEVEL} AS raw")
    return df.select("event_id", n.severity(F.col("raw")).alias("severity"))


@query("n7_event_payload", f"SELECT {_PAYLOAD} AS payload, count(*) AS n FROM events WHERE {_EVENT_OK} GROUP BY 1")
def _(spark, sf):
    return ingested(spark, sf).groupBy("payload").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n8_log_payload",
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'replaced' ELSE concat('m', CAST(event_id AS VARCHAR)) END AS message
        FROM events WHERE event_id % 40 > 1
        UNION ALL SELECT 'no default level' FROM events WHERE event_id % 40 = 1""",
)
def _(spark, sf):
    good = jsonl.parse_log_lines(log_lines(spark, sf), NOW_MS)[0]
    return good.select(n.json_str(F.col("payload"), "message").alias("message"))


_RAW_IP = (
    "CASE event_id % 3 WHEN 0 THEN concat(' 10.0.0.', CAST(user_id % 256 AS STRING)) WHEN 1 THEN '2001:db8::1'"
    " ELSE '::ffff:1.2.3.4' END"
)


@query(
    "n9_ip",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('::ffff:10.0.0.', CAST(user_id % 256 AS VARCHAR))
        WHEN 1 THEN '2001:db8::1' ELSE '::ffff:1.2.3.4' END AS ip FROM events""",
)
def _(spark, sf):
    df = _from(spark, sf, "events", "event_id", f"{_RAW_IP} AS raw")
    return df.select("event_id", n.norm_ip(F.col("raw")).alias("ip"))


@query(
    "n10_client_ip",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('10.1.0.', CAST(user_id % 256 AS VARCHAR))
        ELSE '172.16.0.9' END AS ip FROM events""",
)
def _(spark, sf):
    xff = (
        "CASE event_id % 3 WHEN 0 THEN concat(' 10.1.0.', CAST(user_id % 256 AS STRING), ', 10.9.9.9')"
        " WHEN 1 THEN 'unknown, 10.9.9.9' ELSE NULL END AS xff"
    )
    df = _from(spark, sf, "events", "event_id", xff)
    none = F.lit(None).cast("string")
    return df.select("event_id", n.client_ip(none, F.col("xff"), F.lit("172.16.0.9")).alias("ip"))


@query("n11_locale", "SELECT c_custkey, rpad(substr(c_mktsegment, 1, c_custkey % 8 + 1), 5, ' ') AS locale FROM customer")
def _(spark, sf):
    df = _from(spark, sf, "customer", "c_custkey", "substr(c_mktsegment, 1, CAST(c_custkey % 8 + 1 AS INT)) AS raw")
    return df.select("c_custkey", n.norm_locale(F.col("raw")).alias("locale"))


_DASHED = (
    "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',"
    " substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1),"
    " substr(h, 18, 3), '-', substr(h, 21, 12))"
)


@query(
    "n12_user_id",
    f"""SELECT email, {_DASHED} AS user_id FROM (SELECT email,
        sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(email)) AS h FROM v_users)""",
)
def _(spark, sf):
    return users(spark, sf).select("email", n.user_id_from_email(F.concat(F.lit(" "), F.upper("email"))).alias("user_id"))


@query("n13_json_str", "SELECT event_id, json_extract_string(properties, '$.k') AS k FROM v_events")
def _(spark, sf):
    return events(spark, sf).select("event_id", n.json_str(F.col("properties"), "k").alias("k"))


@query(
    "n14_json_map",
    """SELECT event_id, 'k' AS key, json_extract_string(properties, '$.k') AS value FROM v_events
        UNION ALL SELECT event_id, 'name', event_name FROM v_events""",
)
def _(spark, sf):
    made = "concat('{\"props\":{\"name\":\"', event_name, '\",', substr(properties, 2), '}') AS m"
    df = events(spark, sf).selectExpr("event_id", made)
    return df.select("event_id", F.explode(n.json_map(F.col("m"), "props")).alias("key", "value"))


@query(
    "n15_message_text",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN message WHEN 1 THEN concat('{"msg":5,"text":"', message, '"}')
        WHEN 2 THEN concat('{"other":"', message, '"}') ELSE message END AS message
        FROM v_logs WHERE event_id % 4 <> 1
        UNION ALL SELECT event_id, message FROM v_logs WHERE event_id % 4 = 1""",
)
def _(spark, sf):
    payload = (
        "CASE event_id % 4 WHEN 0 THEN concat('{\"event\":\"e\",\"message\":\"', message, '\"}') WHEN 1 THEN"
        " concat('{\"msg\":5,\"text\":\"', message, '\"}') WHEN 2 THEN concat('{\"other\":\"', message, '\"}')"
        " ELSE message END AS payload"
    )
    return jsonl.message_text(logs(spark, sf).selectExpr("event_id", payload)).drop("payload")


@query(
    "n16_assign_workspace",
    "SELECT event_id, n_nationkey AS workspace_id FROM events JOIN nation ON n_nationkey = user_id % 40",
)
def _(spark, sf):
    rows = _from(spark, sf, "events", "event_id", "concat('key-', CAST(user_id % 40 AS STRING)) AS api_key")
    keys = _from(spark, sf, "nation", "concat('key-', CAST(n_nationkey AS STRING)) AS api_key",
                 "n_nationkey AS workspace_id")
    return jsonl.assign_workspace(rows, keys)


# --- typed tables


@query(
    "r1_events_table",
    f"""SELECT {_STAMP} AS timestamp, event_type AS event_name, {_DEVICE} AS device_id, {_NIL} AS session_id,
        {_IP} AS source_ip, {_PAYLOAD} AS properties, {_PAYLOAD} AS _raw
        FROM events WHERE {_EVENT_OK} AND event_id % 10 > 3""",
)
def _(spark, sf):
    return _plain_time(t.to_events(ingested(spark, sf)))


_IDENTIFIED = f"(SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat('user', CAST(user_id AS VARCHAR), '@example.com'))) AS h FROM events WHERE {_EVENT_OK} AND event_id % 10 = 0)"  # noqa: E501


@query(
    "r2_users_table",
    f"""SELECT {_DASHED} AS user_id, concat(' User', CAST(user_id AS VARCHAR), '@Example.com') AS email, '' AS name,
        {_STAMP} AS updated_at FROM {_IDENTIFIED}""",
)
def _(spark, sf):
    return _plain_time(t.to_users(ingested(spark, sf)), "updated_at")


@query(
    "r3_user_devices_table",
    f"SELECT {_DASHED} AS user_id, {_DEVICE} AS device_id, {_STAMP} AS linked_at FROM {_IDENTIFIED}",
)
def _(spark, sf):
    return _plain_time(t.to_user_devices(ingested(spark, sf)), "linked_at")


@query(
    "r4_user_traits_table",
    f"""SELECT {_DASHED} AS user_id, trait_key, CASE trait_key WHEN 'plan' THEN concat('p', CAST(event_id % 3 AS VARCHAR))
        ELSE CAST(event_id % 7 AS VARCHAR) END AS trait_value, {_STAMP} AS updated_at
        FROM {_IDENTIFIED}, (VALUES ('plan'), ('seats')) AS k(trait_key)""",
)
def _(spark, sf):
    return _plain_time(t.to_user_traits(ingested(spark, sf)), "updated_at")


@query(
    "r5_context_table",
    f"""SELECT {_STAMP} AS timestamp, {_DEVICE} AS device_id, {_NIL} AS session_id, {_IP} AS source_ip,
        'mobile' AS device_type, '' AS device_model, '' AS operating_system, '' AS os_version, '' AS app_version,
        '' AS app_build, '' AS timezone, 'en   ' AS locale, concat('c', CAST(user_id % 25 AS VARCHAR)) AS country,
        '' AS region, '' AS city, {_PAYLOAD} AS properties FROM events WHERE {_EVENT_OK} AND event_id % 10 = 1""",
)
def _(spark, sf):
    return _plain_time(t.to_context(ingested(spark, sf)))


@query(
    "r6_unsupported",
    f"""SELECT CASE event_id % 10 WHEN 2 THEN 'group' ELSE 'unknown' END AS event_type, count(*) AS n
        FROM events WHERE {_EVENT_OK} AND event_id % 10 IN (2, 3) GROUP BY 1""",
)
def _(spark, sf):
    return t.unsupported(ingested(spark, sf)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("r8_fan_out", f"""SELECT 'events_v1' AS "table", count(*) AS n FROM events WHERE {_EVENT_OK} AND event_id % 10 > 3
    UNION ALL SELECT 'context_v1', count(*) FROM events WHERE {_EVENT_OK} AND event_id % 10 = 1
    UNION ALL SELECT 'users_v1', count(*) FROM events WHERE {_EVENT_OK} AND event_id % 10 = 0
    UNION ALL SELECT 'user_devices', count(*) FROM events WHERE {_EVENT_OK} AND event_id % 10 = 0
    UNION ALL SELECT 'user_traits', 2 * count(*) FROM events WHERE {_EVENT_OK} AND event_id % 10 = 0""")  # fmt: skip
def _(spark, sf):
    base = scratch(spark, "tables")
    files.write_tables(base, events=ingested(spark, sf).withColumn("workspace_id", F.lit(1)))
    counts = None
    for name in t.EVENT_TABLES:
        one = lake.scan_table(spark, base, 1, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table"), "n"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


_PROFILES = "concat('user', CAST(o_custkey AS STRING)) AS user_id", "concat('n', CAST(o_orderkey AS STRING)) AS name"


@query(
    "r9_latest_users",
    """SELECT user_id, max(updated_at) AS updated_at, arg_max(name, (updated_at, name)) AS name FROM (
        SELECT concat('user', CAST(o_custkey AS VARCHAR)) AS user_id, concat('n', CAST(o_orderkey AS VARCHAR)) AS name,
        o_orderdate AS updated_at FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    return t.latest_users(_from(spark, sf, "orders", *_PROFILES, "o_orderdate AS updated_at"))


@query(
    "r10_latest_patterns",
    """SELECT o_custkey AS pattern_id, max(o_orderdate) AS last_updated, arg_max(o_orderkey, (o_orderdate, o_orderkey))
        AS occurrence_count FROM orders GROUP BY 1""",
)
def _(spark, sf):
    rows = _from(spark, sf, "orders", "o_custkey AS pattern_id", "o_orderdate AS last_updated",
                 "o_orderkey AS occurrence_count")
    return t.latest_patterns(rows)


@query("r11_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-08-01 12:00:00'")
def _(spark, sf):
    rows = _from(spark, sf, "orders", "o_orderkey", "o_orderdate AS timestamp")
    return t.apply_ttl(rows, "events_v1", datetime(2001, 8, 1, 12)).select("o_orderkey")


RULES = [
    Rule(("audit", "lake"), source="web-1", source_type="error"),
    Rule(("archive",), source_type="view"),
    Rule(("nowhere",)),
    Rule(("live",), source="web-2"),
]


@query(
    "r12_route",
    """SELECT event_id, unnest(sinks) AS sink FROM (SELECT event_id, CASE
        WHEN user_id % 4 = 1 AND event_type = 'error' THEN ['audit', 'lake'] WHEN event_type = 'view' THEN ['archive']
        WHEN user_id % 4 = 2 THEN ['live'] ELSE ['lake'] END AS sinks FROM events)""",
)
def _(spark, sf):
    rows = _from(spark, sf, "events", "event_id", "concat('web-', CAST(user_id % 4 AS STRING)) AS source",
                 "event_type AS source_type")
    return route(rows, RULES, ["lake"]).select("event_id", F.explode("sinks").alias("sink"))


@query(
    "r13_events_with_context",
    """SELECT e.event_id, e.device_id, c.device_type, c.operating_system, c.country FROM v_events e
        JOIN (SELECT DISTINCT device_id, device_type, operating_system, country FROM v_context) c
        ON e.device_id = c.device_id""",
)
def _(spark, sf):
    joined = t.events_with_context(events(spark, sf), context(spark, sf))
    return joined.select("event_id", "device_id", "device_type", "operating_system", "country")


_SPANS = f"""SELECT timestamp, session_id, concat('span ', event_name) AS name FROM v_events WHERE value > 10"""
_MEASURED = f"""SELECT timestamp, session_id, concat('metric ', level) AS name FROM v_logs WHERE level <> 'TRACE'"""


@query(
    "r14_session_timeline",
    f"""SELECT * FROM (SELECT 'event' AS signal, timestamp, session_id, event_name AS label FROM v_events
        UNION ALL SELECT 'log', timestamp, session_id, message FROM v_logs
        UNION ALL SELECT 'span', * FROM ({_SPANS}) UNION ALL SELECT 'metric', * FROM ({_MEASURED}))
        WHERE {IN_LATER} AND session_id = '7-2024-01-20'""",
)
def _(spark, sf):
    spans = events(spark, sf).where("value > 10").selectExpr("timestamp", "session_id", "concat('span ', event_name) AS name")
    measured = logs(spark, sf).where("level <> 'TRACE'").selectExpr(
        "timestamp", "session_id", "concat('metric ', level) AS name"
    )
    return t.session_timeline("7-2024-01-20", frames(spark, sf), spans, measured, parse_range(LATER))


@query(
    "t10_lake_days",
    f"""SELECT CAST(timestamp AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM v_events
        WHERE {IN_LATER} AND workspace_id = 2 GROUP BY 1""",
)
def _(spark, sf):
    """A metric over the lake; the scan lists the folders of the range's days only."""
    base = scratch(spark, "days")
    files.write_table(events(spark, sf), base, "events_v1")
    period = parse_range(LATER)
    scanned = lake.scan_table(spark, base, 2, "events_v1", period)
    points = metrics.event_count(Frames(events=scanned), Filter(period))
    return points.select(F.to_date("date").alias("date"), "value")


@query(
    "r8_two_batches",
    "SELECT event_id, CAST(2 AS BIGINT) AS n FROM v_events WHERE workspace_id = 3",
)
def _(spark, sf):
    """Two unnamed batches are both kept; a named one written again is there once."""
    base = scratch(spark, "batches")
    rows = events(spark, sf).where("workspace_id = 3")
    files.write_table(rows, base, "events_v1")
    for _ in range(2):
        files.write_table(rows, base, "events_v1", "again")
    return lake.scan_table(spark, base, 3, "events_v1").groupBy("event_id").agg(F.count("*").alias("n"))


_QUARTER = "date_trunc('quarter', o_orderdate)"


@query("r11_expired", f"SELECT o_orderkey FROM orders WHERE {_QUARTER} >= TIMESTAMP '1996-07-31'")
def _(spark, sf):
    """Day folders before the table's retention are gone from disk."""
    base = scratch(spark, "expiry")
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_QUARTER} AS timestamp", "1 AS workspace_id")
    files.write_table(rows, base, "events_v1")
    lake.expire(spark, base, "events_v1", datetime(2001, 8, 1, 12))
    return lake.scan_table(spark, base, 1, "events_v1").select("o_orderkey")
