"""Time predicates, buckets and query-side conditions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import IN_RANGE, RANGE, events, logs, query
from signalspark.functions.buckets import bucket
from signalspark.functions.filters import Condition, Filter
from signalspark.functions.ranges import parse_range
from signalspark.operators import aggregates as agg

DAILY = Filter.over(RANGE)
NOW = datetime(2024, 1, 18, 9, 30)

# --- ranges, each as the rows that fall into it

for _name, _text, _first, _last in (
    ("today", "today", "2024-01-18", "2024-01-18"),
    ("week_to_date", "wtd", "2024-01-15", "2024-01-18"),
    ("seven_days", "7d", "2024-01-12", "2024-01-18"),
    ("explicit", "2024-01-03, 2024-01-09", "2024-01-03", "2024-01-09"),
):
    _sql = (
        "SELECT event_id, timestamp FROM v_events"
        f" WHERE timestamp >= TIMESTAMP '{_first} 00:00:00' AND timestamp <= TIMESTAMP '{_last} 23:59:59'"
    )

    @query(f"t10_range_{_name}", _sql)
    def _(spark, sf, text=_text):
        df = events(spark, sf)
        return df.where(parse_range(text, NOW).predicate(df)).select("event_id", "timestamp")


# --- buckets

for _n, (_name, _unit) in enumerate(
    [
        ("minute", "minute"),
        ("hourly", "hour"),
        ("daily", "day"),
        ("weekly", "week"),
        ("monthly", "month"),
        ("quarterly", "quarter"),
        ("yearly", "year"),
    ],
    1,
):
    _type = "TIMESTAMP" if _name in ("minute", "hourly") else "DATE"
    _sql = f"SELECT CAST(date_trunc('{_unit}', timestamp) AS {_type}) AS date, count(*) AS n FROM v_events GROUP BY 1"

    @query(f"g{_n}_bucket_{_name}", _sql)
    def _(spark, sf, name=_name):
        date = bucket(name, F.col("timestamp")).alias("date")
        return events(spark, sf).groupBy(date).agg(F.count(F.lit(1)).alias("n"))


@query("g8_rolling", f"SELECT CAST(count(*) AS DOUBLE) AS value FROM v_events WHERE {IN_RANGE}")
def _(spark, sf):
    return agg.count_query(events(spark, sf), Filter.over(RANGE, granularity=None))


# --- conditions: (query name, view, condition, the same in SQL)

CONDITIONS = [
    ("f1_eq", "v_events", Condition("event_name", "eq", "purchase"), "event_name = 'purchase'"),
    ("f2_ne", "v_events", Condition("event_name", "ne", "purchase"), "event_name <> 'purchase'"),
    ("f3_gt", "v_events", Condition("value", "gt", "20.5"), "value > 20.5"),
    ("f4_gte", "v_events", Condition("event_id", "gte", "500"), "event_id >= 500"),
    ("f5_lt", "v_events", Condition("value", "lt", "3.25"), "value < 3.25"),
    ("f6_lte", "v_events", Condition("event_id", "lte", "500"), "event_id <= 500"),
    ("f7_contains", "v_logs", Condition("message", "contains", "did view"), "contains(message, 'did view')"),
    ("f8_not_contains", "v_logs", Condition("message", "not_contains", "%"), "NOT contains(message, '%')"),
    ("f9_starts_with", "v_logs", Condition("message", "starts_with", "User 1"), "starts_with(message, 'User 1')"),
    ("f10_ends_with", "v_logs", Condition("message", "ends_with", "7"), "ends_with(message, '7')"),
    ("f11_in", "v_events", Condition("event_name", "in", ["view", "click"]), "event_name IN ('view', 'click')"),
    ("f12_not_in", "v_events", Condition("event_name", "not_in", ["view"]), "event_name NOT IN ('view')"),
    ("f13_is_set", "v_events", Condition("properties.k", "is_set"), "json_extract_string(properties, '$.k') IS NOT NULL"),
    ("f14_is_not_set", "v_events", Condition("properties.z", "is_not_set"), "json_extract_string(properties, '$.z') IS NULL"),
    ("f15_regex", "v_logs", Condition("message", "regex", r"request \d*5$"), r"regexp_matches(message, 'request \d*5$')"),
    ("f17_json_path", "v_events", Condition("properties.k", "eq", "42"), "json_extract_string(properties, '$.k') = '42'"),
    ("f18_ip_eq", "v_events", Condition("source_ip", "eq", " 10.0.7.1 "), "source_ip = '::ffff:10.0.7.1'"),
    ("f18_ip_ne", "v_events", Condition("source_ip", "ne", "::ffff:10.0.7.1"), "source_ip <> '::ffff:10.0.7.1'"),
    ("f18_ip_in", "v_events", Condition("source_ip", "in", ["10.0.7.1", "10.0.8.1"]), "source_ip IN ('::ffff:10.0.7.1', '::ffff:10.0.8.1')"),
    ("f18_ip_not_in", "v_events", Condition("source_ip", "not_in", ["10.0.7.1"]), "source_ip NOT IN ('::ffff:10.0.7.1')"),
    ("f18_ip_is_set", "v_events", Condition("source_ip", "is_set"), "source_ip IS NOT NULL"),
]

for _name, _view, _condition, _where in CONDITIONS:

    @query(_name, f"SELECT event_id FROM {_view} WHERE {_where}")
    def _(spark, sf, view=_view, condition=_condition):
        df = {"v_events": events, "v_logs": logs}[view](spark, sf)
        return df.where(condition.to_column(df)).select("event_id")


@query("f20_limit", f"SELECT event_id FROM v_events WHERE {IN_RANGE} ORDER BY event_id LIMIT 1500")
def _(spark, sf):
    f = DAILY.with_limit(1500)
    return f.capped(f.apply(events(spark, sf)).select("event_id").orderBy("event_id"))


@query(
    "f22_shortcuts",
    f"SELECT event_id FROM v_logs WHERE {IN_RANGE} AND service = 'svc-3' AND level = 'ERROR' AND source = 'web-1'",
)
def _(spark, sf):
    return DAILY.where(service="svc-3", level="ERROR", source="web-1").apply(logs(spark, sf)).select("event_id")
