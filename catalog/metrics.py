"""Aggregations, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    IN_EARLIER,
    IN_LATER,
    IN_RANGE,
    LATER,
    RANGE,
    context,
    events,
    frames,
    query,
)
from signalspark.functions.filters import Condition, Filter
from signalspark.operators import aggregates as agg
from signalspark.operators import metrics as m
from signalspark.operators.sketches import daily_sketches, distinct_from_sketches
from signalspark.plans.specs import MetricSpec, run_series, run_spec

DAILY = Filter.over(RANGE)
WEEKLY = Filter.over(RANGE, granularity="weekly")
MONTHLY = Filter.over(RANGE, granularity="monthly")
ROLLING = Filter.over(RANGE, granularity=None)
COMPARED = Filter.over(LATER, compare="previous")

DAY = "CAST(timestamp AS DATE) AS date"
WEEK = "CAST(date_trunc('week', timestamp) AS DATE) AS date"
MONTH = "CAST(date_trunc('month', timestamp) AS DATE) AS date"
COUNT = "CAST(count(*) AS DOUBLE) AS value"
DEVICES = "CAST(count(DISTINCT device_id) AS DOUBLE) AS value"
SESSIONS = "CAST(count(DISTINCT session_id) AS DOUBLE) AS value"


def select(what, view, extra="", group=""):
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT {what} FROM {view} WHERE {IN_RANGE}{extra}{tail}"


# --- aggregations


@query("a1_count_daily", select(f"{DAY}, {COUNT}", "v_events", group="1"))
def _(spark, sf):
    return agg.count_query(events(spark, sf), DAILY)


@query("a2_count_distinct_daily", select(f"{DAY}, {DEVICES}", "v_events", group="1"))
def _(spark, sf):
    return agg.count_distinct_query(events(spark, sf), "device_id", DAILY)


@query(
    "a3_breakdown_daily",
    select(f"{DAY}, event_name AS dimension, CAST(sum(value) AS DECIMAL(18,2)) AS value", "v_events", group="1, 2"),
)
def _(spark, sf):
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    points = agg.breakdown_query(events(spark, sf), total, "event_name", DAILY)
    return points.withColumn("value", F.col("value").cast("decimal(18,2)"))


@query(
    "a4_top_n",
    select("device_id AS dimension, " + COUNT, "v_events", group="1") + " ORDER BY value DESC, dimension LIMIT 25",
)
def _(spark, sf):
    return agg.top_n(events(spark, sf), "device_id", DAILY, n=25)


_K = "TRY_CAST(json_extract_string(properties, '$.k') AS DOUBLE)"
for _fn in ("sum", "avg", "min", "max", "count"):
    _sql = select(f"{DAY}, CAST({_fn}({_K}) AS DOUBLE) AS value", "v_events", group="1")

    @query(f"a5_custom_{_fn}", _sql)
    def _(spark, sf, fn=_fn):
        return agg.custom_aggregate(events(spark, sf), "properties.k", fn, DAILY)


@query(
    "a6_raw_data",
    select("timestamp, event_name, device_id, event_id", "v_events")
    + " ORDER BY timestamp DESC, event_name, device_id, event_id LIMIT 500",
)
def _(spark, sf):
    return agg.raw_data(events(spark, sf), ["timestamp", "event_name", "device_id", "event_id"], DAILY, n=500)


@query("a7_distinct_values", select("DISTINCT session_id", "v_events") + " ORDER BY 1 LIMIT 1000")
def _(spark, sf):
    return agg.distinct_values(events(spark, sf), "session_id", DAILY, n=1000)


_POINTS = f"({select(f'{DAY}, event_name AS dimension, {COUNT}', 'v_events', group='1, 2')})"
_STATS = (
    "coalesce(sum(value), 0) AS total, coalesce(min(value), 0) AS min,"
    " coalesce(max(value), 0) AS max, coalesce(avg(value), 0) AS avg"
)


@query("a9_series_stats", f"SELECT {_STATS} FROM {_POINTS}")
def _(spark, sf):
    return agg.series_stats(m.event_count(frames(spark, sf), DAILY, by="event_name"))


@query(
    "a10_grouped_series",
    f"SELECT dimension, {_STATS}, grouping(dimension) = 1 AS is_total FROM {_POINTS} GROUP BY ROLLUP (dimension)",
)
def _(spark, sf):
    return agg.grouped_series(m.event_count(frames(spark, sf), DAILY, by="event_name"))


def compared(current, previous):
    """Totals of two one-column selects named value, and their difference."""
    return f"""SELECT c AS current_total, p AS previous_total, c - p AS change,
        CASE WHEN p <> 0 THEN (c - p) / p * 100 WHEN c > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS percent_change
        FROM (SELECT coalesce((SELECT sum(value) FROM ({current})), 0.0)::DOUBLE AS c,
                     coalesce((SELECT sum(value) FROM ({previous})), 0.0)::DOUBLE AS p)"""


def halves(what, view, extra="", group="1"):
    return [f"SELECT {what} FROM {view} WHERE {span}{extra} GROUP BY {group}" for span in (IN_LATER, IN_EARLIER)]


@query("a11_compare_totals", compared(*halves(f"{DAY}, {COUNT}", "v_events")))
def _(spark, sf):
    f = frames(spark, sf)
    return agg.compare(m.event_count(f, COMPARED), m.event_count(f, COMPARED.comparison()))


_NOW, _BEFORE = halves(f"{DAY}, {DEVICES}", "v_context")


@query(
    "a12_compare_points",
    f"""SELECT 'current' AS period, date, value, CAST(date - DATE '2024-01-16' AS BIGINT) AS bucket_offset FROM ({_NOW})
    UNION ALL SELECT 'previous', date, value, CAST(date - DATE '2024-01-01' AS BIGINT) FROM ({_BEFORE})""",
)
def _(spark, sf):
    return m.with_comparison(m.dau, frames(spark, sf), COMPARED, with_points=True)


# --- engagement


@query("m1_dau", select(f"{DAY}, {DEVICES}", "v_context", group="1"))
def _(spark, sf):
    return m.dau(frames(spark, sf), DAILY)


@query("m2_wau", select(f"{WEEK}, {DEVICES}", "v_context", group="1"))
def _(spark, sf):
    return m.wau(frames(spark, sf), WEEKLY)


@query("m3_mau", select(f"{MONTH}, {DEVICES}", "v_context", group="1"))
def _(spark, sf):
    return m.mau(frames(spark, sf), MONTHLY)


@query("m4_active_users_by", select(f"{DAY}, device_type AS dimension, {DEVICES}", "v_context", group="1, 2"))
def _(spark, sf):
    return m.active_users(frames(spark, sf), DAILY, by="device_type")


@query("m5_sessions", select(f"{DAY}, {COUNT}", "v_context", group="1"))
def _(spark, sf):
    return m.sessions(frames(spark, sf), DAILY)


@query("m6_unique_sessions", select(f"{WEEK}, {SESSIONS}", "v_context", group="1"))
def _(spark, sf):
    return m.unique_sessions(frames(spark, sf), WEEKLY)


@query("m7_sessions_by", select(f"{DAY}, country AS dimension, {COUNT}", "v_context", group="1, 2"))
def _(spark, sf):
    return m.sessions(frames(spark, sf), DAILY, by="country")


for _field in ("device_type", "country", "operating_system"):
    _sql = select(f"{_field} AS dimension, {COUNT}", "v_context", group="1")

    @query(f"m8_top_sessions_{_field}", _sql + " ORDER BY value DESC, dimension LIMIT 10")
    def _(spark, sf, field=_field):
        return m.top_sessions(frames(spark, sf), DAILY, field)


@query(
    "m9_users_count",
    f"SELECT CAST(updated_at AS DATE) AS date, {COUNT} FROM v_users"
    f" WHERE {IN_RANGE.replace('timestamp >=', 'updated_at >=').replace('timestamp <=', 'updated_at <=')} GROUP BY 1",
)
def _(spark, sf):
    return m.users_count(frames(spark, sf), DAILY)


@query("m10_distinct_users", select(DEVICES, "v_context"))
def _(spark, sf):
    return m.distinct_users(frames(spark, sf), ROLLING)


for _name, _filter, _bucket in (("m11_stickiness_daily", DAILY, DAY), ("m12_stickiness_weekly", WEEKLY, WEEK)):
    _sql = select(f"{_bucket}, {DEVICES}", "v_context", group="1")

    @query(_name, f"SELECT date, value / (sum(value) OVER ()) * 100 AS value FROM ({_sql})")
    def _(spark, sf, f=_filter):
        return m.stickiness_share(frames(spark, sf), f)


def _ratio_sql(width):
    return f"""SELECT date, CAST(n AS DOUBLE) / d * 100 AS value FROM (
        SELECT c.date, count(DISTINCT CASE WHEN a.day > c.date - {width} THEN a.device_id END) AS n,
            count(DISTINCT a.device_id) AS d
        FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE)
              AS date) c
        JOIN (SELECT DISTINCT device_id, CAST(timestamp AS DATE) AS day FROM v_context
              WHERE timestamp <= TIMESTAMP '2024-01-30 23:59:59') a
          ON a.day <= c.date AND a.day > c.date - 30 GROUP BY 1)"""


for _name, _num, _width in (("m13_stickiness_dau_mau", "day", 1), ("m13_stickiness_wau_mau", "week", 7)):

    @query(_name, _ratio_sql(_width))
    def _(spark, sf, num=_num):
        return m.stickiness_ratio(frames(spark, sf), Filter.over("2024-01-05,2024-01-30"), num=num)


# --- product


@query("m14_event_count", select(f"{DAY}, {COUNT}", "v_events", group="1"))
def _(spark, sf):
    return m.event_count(frames(spark, sf), DAILY)


@query("m15_event_count_named", select(f"{DAY}, {COUNT}", "v_events", " AND event_name = 'purchase'", "1"))
def _(spark, sf):
    return m.event_count(frames(spark, sf), DAILY, name="purchase")


@query("m16_event_count_by", select(f"{WEEK}, event_name AS dimension, {COUNT}", "v_events", group="1, 2"))
def _(spark, sf):
    return m.event_count(frames(spark, sf), WEEKLY, by="event_name")


@query(
    "m17_top_events",
    select(f"event_name AS dimension, {COUNT}", "v_events", group="1") + " ORDER BY value DESC, dimension LIMIT 10",
)
def _(spark, sf):
    return m.top_events(frames(spark, sf), DAILY)


@query(
    "m18_event_property_breakdown",
    select(
        f"{DAY}, json_extract_string(properties, '$.k') AS dimension, {COUNT}",
        "v_events",
        " AND event_name = 'purchase'",
        "1, 2",
    ),
)
def _(spark, sf):
    return m.event_property_breakdown(frames(spark, sf), DAILY, "purchase", "properties.k")


@query(
    "m19_custom_event_metric",
    select(f"{DAY}, sum({_K}) AS value", "v_events", " AND event_name = 'purchase'", "1"),
)
def _(spark, sf):
    return m.custom_event_metric(frames(spark, sf), DAILY, "purchase", "properties.k", "sum")


# --- logs


@query("m20_log_volume", select(f"{DAY}, {COUNT}", "v_logs", group="1"))
def _(spark, sf):
    return m.log_volume(frames(spark, sf), DAILY)


@query("m21_log_volume_level", select(f"{DAY}, {COUNT}", "v_logs", " AND level = 'ERROR'", "1"))
def _(spark, sf):
    return m.log_volume(frames(spark, sf), DAILY, level="ERROR")


@query("m22_log_volume_by", select(f"{DAY}, service AS dimension, {COUNT}", "v_logs", group="1, 2"))
def _(spark, sf):
    return m.log_volume(frames(spark, sf), DAILY, by="service")


for _field in ("level", "source", "service"):
    _sql = select(f"{_field} AS dimension, {COUNT}", "v_logs", group="1")

    @query(f"m23_top_logs_{_field}", _sql + " ORDER BY value DESC, dimension LIMIT 10")
    def _(spark, sf, field=_field):
        return m.top_logs(frames(spark, sf), DAILY, field)


# --- drill-down


@query("m24_drill_users", select("DISTINCT device_id", "v_context") + " ORDER BY 1 LIMIT 100")
def _(spark, sf):
    return m.drill_users(frames(spark, sf), DAILY)


_EVENT_COLUMNS = "timestamp, event_name, device_id, session_id"
_EVENT_ORDER = " ORDER BY timestamp DESC, event_name, device_id, session_id LIMIT 100"


@query("m25_drill_events", select(_EVENT_COLUMNS, "v_events") + _EVENT_ORDER)
def _(spark, sf):
    return m.drill_events(frames(spark, sf), DAILY)


@query(
    "m26_drill_logs",
    select("timestamp, level, message, source", "v_logs")
    + " ORDER BY timestamp DESC, level, message, source LIMIT 100",
)
def _(spark, sf):
    return m.drill_logs(frames(spark, sf), DAILY)


@query("m27_drill_sessions", select("DISTINCT session_id", "v_context") + " ORDER BY 1 LIMIT 100")
def _(spark, sf):
    return m.drill_sessions(frames(spark, sf), DAILY)


@query("m28_drill_event", select(_EVENT_COLUMNS, "v_events", " AND event_name = 'click'") + _EVENT_ORDER)
def _(spark, sf):
    return m.drill_events(frames(spark, sf), DAILY, event="click")


# --- comparison, saved specs, boards


@query("m29_dau_compared", compared(_NOW, _BEFORE))
def _(spark, sf):
    return m.with_comparison(m.dau, frames(spark, sf), COMPARED)


@query("m29_log_volume_compared", compared(*halves(f"{DAY}, {COUNT}", "v_logs", " AND level = 'ERROR'")))
def _(spark, sf):
    f = COMPARED.where(level="ERROR")
    return m.with_comparison(m.log_volume, frames(spark, sf), f)


_YEAR_BEFORE = IN_LATER.replace("2024", "2023")


@query(
    "m29_event_count_year_over_year",
    compared(
        f"SELECT {DAY}, {COUNT} FROM v_events WHERE {IN_LATER} GROUP BY 1",
        f"SELECT {DAY}, {COUNT} FROM v_events WHERE {_YEAR_BEFORE} GROUP BY 1",
    ),
)
def _(spark, sf):
    return m.with_comparison(m.event_count, frames(spark, sf), Filter.over(LATER, compare="yoy"))


@query(
    "m31_saved_spec",
    f"SELECT {DAY}, device_type AS dimension, {DEVICES} FROM v_context"
    f" WHERE {IN_LATER} AND operating_system <> 'iOS' GROUP BY 1, 2",
)
def _(spark, sf):
    spec = MetricSpec(
        metric="dau",
        range=LATER,
        filters=(Condition("operating_system", "ne", "iOS"),),
        breakdown="device_type",
        granularity="daily",
    )
    return run_spec(frames(spark, sf), spec)


@query(
    "m32_board_series",
    f"""SELECT 'active' AS series, date, value, CAST(NULL AS VARCHAR) AS dimension
          FROM ({select(f"{DAY}, {DEVICES}", "v_context", group="1")})
        UNION ALL SELECT 'monthly', date, value, NULL FROM ({select(f"{MONTH}, {DEVICES}", "v_context", group="1")})
        UNION ALL SELECT 'by level', date, value, dimension
          FROM ({select(f"{WEEK}, level AS dimension, {COUNT}", "v_logs", group="1, 2")})""",
)
def _(spark, sf):
    return run_series(
        frames(spark, sf),
        {
            "active": MetricSpec("dau", RANGE),
            "monthly": MetricSpec("mau", RANGE, granularity="monthly"),
            "by level": MetricSpec("log_volume", RANGE, granularity="weekly", breakdown="level"),
        },
    )


@query("a2_context_sessions_rolling", select(SESSIONS, "v_context"))
def _(spark, sf):
    return agg.count_distinct_query(context(spark, sf), "session_id", ROLLING)


@query("a2_context_devices_sketched", select(f"{DAY}, {DEVICES}", "v_context", group="1"))
def _(spark, sf):
    """Daily devices from stored sketches; so few are counted exactly."""
    f = Filter.over(RANGE)
    return distinct_from_sketches(daily_sketches(context(spark, sf), "device_id"), f)
