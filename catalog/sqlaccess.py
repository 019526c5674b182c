"""SQL within one workspace, and value lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import context, events, logs, query, users
from catalog.ingest import scratch
from signalspark.plans.sqlaccess import Workspace, normalise_table_names, render
from signalspark.sinks import files


def workspace(spark, sf, number=2):
    """Views over the adapter tables; context rows take the workspace of their device."""
    owned = "CAST(device_id AS BIGINT) % 3 + 1 AS workspace_id"
    return Workspace(
        spark,
        number,
        {
            "events_v1": lambda s: events(s, sf),
            "context_v1": lambda s: context(s, sf).selectExpr("*", owned),
            "logs_v1": lambda s: logs(s, sf).selectExpr("*", "event_id % 3 + 1 AS workspace_id"),
            "users_v1": lambda s: users(s, sf).selectExpr("*", "c_custkey % 3 + 1 AS workspace_id"),
        },
    )


_MINE = "v_events WHERE workspace_id = 2"


@query("q3_workspace_scope", f"SELECT event_name, CAST(count(*) AS BIGINT) AS n FROM {_MINE} GROUP BY 1")
def _(spark, sf):
    return workspace(spark, sf).run_sql("SELECT event_name, count(*) AS n FROM events_v1 GROUP BY event_name")


@query("q4_qualified_names", f"SELECT device_id, CAST(count(*) AS BIGINT) AS n FROM {_MINE} GROUP BY 1")
def _(spark, sf):
    return workspace(spark, sf).run_sql("select device_id, count(*) AS n from 2.events_v1 group by device_id;")


@query("q5_row_limit", f"SELECT event_id FROM {_MINE} ORDER BY event_id LIMIT 50000")
def _(spark, sf):
    return workspace(spark, sf).run_sql("SELECT event_id FROM events_v1 ORDER BY event_id LIMIT 50000", limit=1000)


@query("q5_row_limit_asked", f"SELECT event_id FROM {_MINE} ORDER BY event_id LIMIT 100")
def _(spark, sf):
    return workspace(spark, sf).run_sql("SELECT event_id FROM events_v1 ORDER BY event_id", limit=100)


@query("q6_sql_many_groups", f"SELECT event_id, CAST(count(*) AS BIGINT) AS n FROM {_MINE} GROUP BY 1")
def _(spark, sf):
    return workspace(spark, sf).run_sql("SELECT event_id, count(*) AS n FROM events_v1 GROUP BY event_id")


_JOINED = """SELECT c.device_type, count(*) AS n FROM {events} e JOIN (SELECT DISTINCT device_id, device_type FROM {context}) c
    ON e.device_id = c.device_id GROUP BY c.device_type"""


@query(
    "q6_sql_join",
    _JOINED.format(
        events=f"(SELECT * FROM {_MINE})", context="(SELECT * FROM v_context WHERE CAST(device_id AS BIGINT) % 3 + 1 = 2)"
    ),
)
def _(spark, sf):
    return workspace(spark, sf).run_sql(_JOINED.format(events="events_v1", context="context_v1"))


_NESTED = """WITH busy AS (SELECT device_id, count(*) AS n FROM {events} GROUP BY device_id)
    SELECT event_name, count(*) AS n, max(n) AS busiest FROM {events} e JOIN busy b ON e.device_id = b.device_id
    WHERE e.device_id IN (SELECT device_id FROM busy WHERE n > 65) GROUP BY event_name"""


@query("q6_sql_subquery", f"SELECT * FROM ({_NESTED.format(events=f'(SELECT * FROM {_MINE})')})")
def _(spark, sf):
    return workspace(spark, sf).run_sql(_NESTED.format(events="2.events_v1"))


@query("q6_sql_lake", "SELECT event_name, CAST(count(*) AS BIGINT) AS n FROM v_events WHERE workspace_id = 3 GROUP BY 1")
def _(spark, sf):
    base = scratch(spark, "sql")
    files.write_table(events(spark, sf), base, "events_v1")
    found = Workspace.of_lake(spark, base, 3)
    return found.run_sql(normalise_table_names("SELECT event_name, count(*) AS n FROM 3.events_v1 GROUP BY 1", 3))


@query(
    "q9_field_values",
    "SELECT DISTINCT device_id FROM v_events WHERE workspace_id = 2 AND contains(device_id, '1') ORDER BY 1 LIMIT 500",
)
def _(spark, sf):
    return workspace(spark, sf).field_values("events", "device_id", "1", 500)


_LINE = """concat('{"device_id":"', device_id, '","event_name":"', event_name, '","n":', CAST(count(*) AS STRING), '}')"""


@query("q10_render", f"SELECT {_LINE} AS text FROM v_events GROUP BY device_id, event_name")
def _(spark, sf):
    counted = events(spark, sf).groupBy("device_id", "event_name").agg(F.count("*").alias("n"))
    return render(counted, "json")


@query(
    "q10_render_table",
    """SELECT concat(rpad(device_id, CAST(w AS INTEGER), ' '), ' | ', rpad(CAST(n AS STRING), CAST(v AS INTEGER), ' ')) AS text
    FROM (SELECT device_id, count(*) AS n FROM v_events GROUP BY 1),
    (SELECT greatest(9, max(length(device_id))) AS w, greatest(1, max(length(CAST(n AS STRING)))) AS v
    FROM (SELECT device_id, count(*) AS n FROM v_events GROUP BY 1))""",
)
def _(spark, sf):
    return render(events(spark, sf).groupBy("device_id").agg(F.count("*").alias("n")))
