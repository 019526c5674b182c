"""Live tail, sinks and streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog.base import events, logs, query
from catalog.ingest import ingested, scratch
from signalspark.sinks import files
from signalspark.sinks.compact import compact_closed
from signalspark.sources import lake
from signalspark.streaming import jobs
from signalspark.streaming import tail as t

_TAILED = [
    "event_id",
    "timestamp",
    "workspace_id",
    "concat('web-', substr(device_id, 1, 1)) AS source_id",
    "CASE WHEN event_id % 3 = 0 THEN 'log' ELSE 'event' END AS batch_type",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat(event_name, '_', CAST(event_id % 20 AS STRING)) END AS event_name",
    "properties AS payload",
]
_VIEW = f"(SELECT {', '.join(_TAILED)} FROM v_events)"


def tailed(spark, sf):
    return events(spark, sf).selectExpr(*_TAILED)


@query(
    "l1_tail_meta",
    f"SELECT event_id FROM {_VIEW} WHERE workspace_id IN (1, 3) AND source_id IN ('web-1', 'web-2') AND batch_type = 'event'",
)
def _(spark, sf):
    return t.tail_meta(tailed(spark, sf), [1, 3], ["web-1", "web-2"], ["event"]).select("event_id")


@query(
    "l2_tail_names",
    f"""SELECT event_id FROM {_VIEW} WHERE regexp_matches(coalesce(event_name, ''), '^view_.*$')
        OR regexp_matches(coalesce(event_name, ''), '^.lick_1.$')""",
)
def _(spark, sf):
    return t.tail_names(tailed(spark, sf), ["view_*", "?lick_1?"]).select("event_id")


@query("l3_tail_levels", "SELECT event_id FROM v_logs WHERE level IN ('ERROR', 'NOTICE')")
def _(spark, sf):
    return t.tail_levels(logs(spark, sf), ["error", "Notice"]).select("event_id")


@query(
    "l4_tail_match",
    f"SELECT event_id FROM {_VIEW} WHERE coalesce(contains(event_name, 'se_1'), false) OR contains(payload, '7}}')",
)
def _(spark, sf):
    columns = ("event_name", "payload")
    narrowed = t.tail_match(tailed(spark, sf), "se_1", columns).select("event_id")
    return narrowed.union(t.tail_match(tailed(spark, sf), "7}", columns).select("event_id")).distinct()


@query(
    "l5_tail_sample",
    f"SELECT event_id FROM {_VIEW} WHERE CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) < {2**30}",
)
def _(spark, sf):
    return t.tail_sample(tailed(spark, sf), 0.25, by="event_id").select("event_id")


@query(
    "l6_tail_rate",
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('second', second) ORDER BY second,
        event_id) AS n FROM (SELECT event_id, date_trunc('day', timestamp) AS second FROM v_events)) WHERE n <= 40""",
)
def _(spark, sf):
    # Times are cut to days, so that each "second" holds many rows.
    rows = tailed(spark, sf).select("event_id", F.date_trunc("DAY", "timestamp").alias("timestamp"))
    return t.tail_rate(rows, 40, order=["event_id"]).select("event_id")


@query("l7_tail_last", f"SELECT event_id, event_name FROM {_VIEW} ORDER BY timestamp DESC, event_id DESC LIMIT 1000")
def _(spark, sf):
    return t.tail_last(tailed(spark, sf), 1000, order=["event_id"]).select("event_id", "event_name")


@query(
    "l8_tail_format",
    f"""SELECT concat('workspace=', workspace_id, ' source=', source_id, ' type=', batch_type, ' count=', count(*),
        ' bytes=', sum(strlen(payload))) AS value FROM {_VIEW} GROUP BY workspace_id, source_id, batch_type""",
)
def _(spark, sf):
    return t.tail_format(tailed(spark, sf), "raw")


# --- sinks

NOW = datetime(2024, 2, 1, 10, 20, 30, 400000)
_BY_WORKSPACE = "user_id % 4"


@query(
    "k1_parquet",
    f"""SELECT CAST(user_id % 4 AS BIGINT) AS workspace_id, DATE '2024-02-01' AS date, '10' AS hour, count(*) AS n,
        sum(event_id)::BIGINT AS ids FROM events WHERE {_BY_WORKSPACE} <> 0 GROUP BY 1""",
)
def _(spark, sf):
    path = scratch(spark, "parquet")
    rows = events(spark, sf).selectExpr(
        "*", "'track' AS event_type", "properties AS payload", "CAST(device_id AS BIGINT) % 4 AS ws"
    )
    rows = rows.drop("workspace_id").withColumnRenamed("ws", "workspace_id")
    rows = rows.withColumn("batch_timestamp", F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz"))
    files.write_parquet(rows, path, codec="zstd")
    back = spark.read.option("basePath", path).parquet(path)
    return back.groupBy(
        F.col("workspace_id").cast("bigint"), F.col("date").cast("date"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("k2_no_workspace", f"SELECT event_id FROM events WHERE {_BY_WORKSPACE} <> 0")
def _(spark, sf):
    rows = events(spark, sf).withColumn("workspace_id", F.col("device_id").cast("bigint") % 4)
    return files.with_workspace(rows).select("event_id")


@query(
    "k3_typed_tables",
    """SELECT trait_key, CASE trait_key WHEN 'plan' THEN concat('p', CAST(event_id % 3 AS VARCHAR))
        ELSE CAST(event_id % 7 AS VARCHAR) END AS trait_value, count(*) AS n
        FROM events, (VALUES ('plan'), ('seats')) AS k(trait_key)
        WHERE event_id % 50 NOT IN (14, 15, 16, 17) AND event_id % 10 = 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    base = scratch(spark, "typed")
    files.write_tables(base, events=ingested(spark, sf).withColumn("workspace_id", F.lit(7)))
    return spark.read.parquet(f"{base}/user_traits").groupBy("trait_key", "trait_value").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "k4_text_lines",
    """SELECT 1 AS workspace_id, concat('[2024-02-01T10:20:30.400Z] [', level, '] session_id=', session_id, ' source=', source,
        ' service=', service, ' timestamp=', CAST(1704067200000 + event_id AS VARCHAR), ' source_ip=- payload=', message,
        '\\tend\\\\') AS value FROM v_logs""",
)
def _(spark, sf):
    rows = logs(spark, sf).select(
        F.lit(1).alias("workspace_id"),
        "level",
        "source",
        "service",
        "session_id",
        F.timestamp_millis(F.lit(1704067200000) + F.col("event_id")).alias("timestamp"),
        F.lit(None).cast("string").alias("source_ip"),
        F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz").alias("batch_timestamp"),
        F.concat("message", F.lit("\tend\\")).alias("payload"),
    )
    return files.text_lines(rows, "logs").drop("date")


# --- streaming


@query(
    "m14_event_count_stream",
    """SELECT CAST(timestamp AS DATE) AS date, event_name AS dimension, CAST(count(*) AS DOUBLE) AS value
        FROM v_events GROUP BY 1, 2""",
)
def _(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    rows = stream.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event_name"))
    counted = jobs.windowed_counts(rows, by="event_name")
    path = scratch(spark, "stream")

    def replace(batch, batch_id):
        batch.write.mode("overwrite").parquet(path)

    writer = counted.writeStream.outputMode("complete").foreachBatch(replace)
    checkpoint = scratch(spark, "progress")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date"))




@query("k3_compacted", "SELECT event_id, level, DATE_TRUNC('day', timestamp)::DATE AS date FROM v_logs")
def _(spark, sf):
    """A lake written in four batches, its closed days merged, and read again."""
    base, rows = scratch(spark, "lake"), logs(spark, sf).withColumn("workspace_id", F.lit(7))
    for batch in range(4):
        files.write_table(rows.where(F.pmod("event_id", F.lit(4)) == batch), base, "logs_v1", f"b{batch}")
    compact_closed(spark, base, "logs_v1", datetime(2024, 1, 20))
    return lake.scan_table(spark, base, 7, "logs_v1").select("event_id", "level", "date")


@query("k6_null", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v_logs")
def _(spark, sf):
    """The sink that keeps nothing still computes every row: what an observation saw of them."""
    seen = Observation()
    files.write_noop(logs(spark, sf).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")))
    return spark.createDataFrame([(seen.get["n"], seen.get["ids"])], "n bigint, ids bigint")
