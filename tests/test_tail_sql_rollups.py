from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from signalspark.operators import rollups as c
from signalspark.operators.reduce import ReduceConfig
from signalspark.operators.routing import Rule
from signalspark.plans import sqlaccess as q
from signalspark.sources import lake
from signalspark.streaming import jobs
from signalspark.streaming import tail as t


def kept(df):
    return [x.id for x in df.orderBy("id").collect()]


@pytest.fixture
def tailed(rows):
    return rows(
        [(1, 7, "a", "event", "page_view", "error", '{"k":"needle"}'), (2, 7, "b", "event", "buy_click", "info", "{}"),
         (3, 8, "a", "log", None, "INFO", None), (4, 8, "c", "log", "pageXview", "fatal", "")],
        "id int, workspace_id int, source_id string, batch_type string, event_name string, level string, payload string",
    )


def test_tail_selections(tailed):
    assert kept(t.tail_meta(tailed, [7, 8], ["a", "b"], ["event"])) == [1, 2]
    assert kept(t.tail_meta(tailed)) == [1, 2, 3, 4]
    assert kept(t.tail_names(tailed, ["page_*", "*_click"])) == [1, 2]
    assert kept(t.tail_names(tailed, ["page?view"])) == [1, 4]
    assert kept(t.tail_names(tailed, ["*"])) == [1, 2, 3, 4]
    assert kept(t.tail_names(tailed, ["?*"])) == [1, 2, 4]
    assert kept(t.tail_levels(tailed, ["INFO"])) == [2, 3]
    assert kept(t.tail_match(tailed, "needle")) == [1]
    assert kept(t.tail_match(tailed, "page.view")) == []
    assert kept(t.tail_match(tailed, "page.view", regex=True)) == [1, 4]


def test_tail_sample(spark):
    df = spark.range(4000)
    assert t.tail_sample(df, 1.5).count() == 4000 and t.tail_sample(df, 0.0).count() == 0
    one, two = (kept(t.tail_sample(df, 0.3, by="id")) for _ in range(2))
    assert one == two and 1000 < len(one) < 1400


@pytest.mark.parametrize("n", [2, 1200])
def test_tail_rate(spark, n):
    df = spark.range(3000).withColumn("timestamp", F.timestamp_millis(F.floor(F.col("id") / 1500) * 1000))
    assert kept(t.tail_rate(df, n, order=["id"])) == [*range(n), *range(1500, 1500 + n)]


def test_tail_formats(tailed):
    stamped = tailed.withColumn("timestamp", F.lit("2024-01-01 10:00:00.5").cast("timestamp"))
    lines = [x.value for x in t.tail_format(stamped, "text").collect()]
    assert lines[0] == '10:00:00.500 page_view {"k":"needle"}' and lines[2] == "10:00:00.500 INFO "
    assert '"event_name":"page_view"' in t.tail_format(stamped, "compact").first().value
    raw = {x.value for x in t.tail_format(stamped, "raw").collect()}
    assert "workspace=7 source=a type=event count=1 bytes=14" in raw
    brief = {x.value for x in t.tail_format(stamped, "text", metadata_only=True).collect()}
    assert "[ws:8] LOG src=a count=1 bytes=0" in brief
    with pytest.raises(ValueError):
        t.tail_format(stamped, "xml")


# --- streams


def write_lines(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_ingest_to_tables(spark, tmp_path):
    line = '{"type":"%s","device_id":"00000000000000000000000000000001","timestamp":1000,"traits":{"email":"a@b.c","plan":"x"}}'
    write_lines(tmp_path / "in", "a.jsonl", [line % "track", line % "identify", "broken"])
    for name in ("b.jsonl", "c.jsonl"):
        job = jobs.ingest_events(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 5, 0)
        run(job)
        write_lines(tmp_path / "in", name, [line % "track"])
    base = str(tmp_path / "out")
    assert lake.scan_table(spark, base, 5, "events_v1").count() == 2
    assert lake.scan_table(spark, base, 5, "user_traits").count() == 2


def test_stream_log_ingest(spark, tmp_path):
    write_lines(tmp_path / "in", "a.jsonl", ['{"message":"x","level":"crit","timestamp":1}', "{}"])
    run(jobs.ingest_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 5, 0))
    row = lake.scan_table(spark, str(tmp_path / "out"), 5, "logs_v1").first()
    assert (row.level, row.severity, row.message) == ("FATAL", 0, '{"message":"x"}')


def stream_of(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_stream_routing_rate_and_repeats(spark, rows, tmp_path):
    df = rows([(i, "tcp" if i % 2 else "udp", datetime(2024, 1, 1)) for i in range(6)], "id int, source string, timestamp timestamp")
    stream = stream_of(spark, df, tmp_path / "in")
    got = {"a": [], "b": []}
    sinks = {"a": lambda b, i: got["a"].extend(kept(b)), "b": t.rate_limited(lambda b, i: got["b"].extend(kept(b)), 2)}
    job = jobs.route_stream(stream, [Rule(("a",), "tcp")], sinks, ["b"])
    run(job.option("checkpointLocation", str(tmp_path / "ck1")))
    assert got["a"] == [1, 3, 5] and len(got["b"]) == 2
    seen = []
    unique = jobs.without_repeats(stream, "source")
    run(unique.writeStream.foreachBatch(lambda b, i: seen.extend(x.source for x in b.collect())).option("checkpointLocation", str(tmp_path / "ck2")))
    assert sorted(seen) == ["tcp", "udp"]


def test_stream_reduce(spark, rows, tmp_path):
    df = rows([("a" if i % 3 else "b", i * 10) for i in range(30)], "message string, ts bigint").coalesce(1)
    out = []
    reduced = jobs.reduce_stream(stream_of(spark, df, tmp_path / "in"), ReduceConfig((), 100, 4, 2), ts="ts")
    writer = reduced.writeStream.outputMode("append").foreachBatch(lambda b, i: out.extend(b.collect()))
    query = writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        deadline = datetime.now().timestamp() + 60
        while sum(x["count"] for x in out) < 30 and datetime.now().timestamp() < deadline:
            query.awaitTermination(1)
    finally:
        query.stop()
    # Groups close after four events or 100 ms; what stays open is closed by the clock.
    assert sorted((x.key, x.first_ts, x["count"], x.last_ts) for x in out) == [
        ("a", 10, 4, 50), ("a", 70, 4, 110), ("a", 130, 4, 170), ("a", 190, 4, 230), ("a", 250, 4, 290),
        ("b", 0, 4, 90), ("b", 120, 4, 210), ("b", 240, 2, 270),
    ]


def run_to_end(frame, tmp_path, name):
    out = []
    writer = frame.writeStream.outputMode("append").foreachBatch(lambda b, i: out.extend(b.collect()))
    query = writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return out


def test_event_time_reduction_equals_batch(spark, rows, tmp_path):
    import random

    from signalspark.operators.reduce import reduce_groups, reduce_key
    from signalspark.streaming.eventtime import reduce_by_event_time

    rnd = random.Random(6)
    data = [(rnd.choice("abc"), rnd.randrange(20_000)) for _ in range(150)] + [("a", None), ("b", None), ("a", None)]
    kinds, config = "message string, ts bigint", ReduceConfig((), 700, 4, 2)
    # batches out of order by less than 3 seconds, then two that move the watermark past all windows
    data.sort(key=lambda r: -1 if r[1] is None else r[1] + rnd.randrange(2500))
    parts = [data[i : i + 40] for i in range(0, len(data), 40)] + [[("end", 500_000)], [("end", 900_000)]]
    for i, part in enumerate(parts):
        rows(part, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    found = run_to_end(reduce_by_event_time(stream.parquet(str(tmp_path / "in")), config, ts="ts", late="3 seconds"), tmp_path, "ck")
    batch = reduce_groups(reduce_key(rows(data, kinds), (), "message", "k"), "k", "ts", 700, 4, ("message",))
    expected = [(r.key, r.first_ts, r.last_ts, r["count"]) for r in batch.collect()]
    got = [(r.key, r.first_ts, r.last_ts, r["count"]) for r in found if r.key != "end"]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) > 60


def test_the_rate_limit_holds_over_micro_batches(spark, rows, tmp_path):
    from signalspark.streaming.eventtime import limit_stream

    kinds, start = "id bigint, timestamp timestamp", datetime(2024, 1, 1, tzinfo=timezone.utc)
    parts = [[(i * 10 + b, start + timedelta(milliseconds=100 * i + b)) for i in range(20)] for b in range(3)]
    for b, part in enumerate(parts):
        rows(part, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{b}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    found = run_to_end(limit_stream(stream.parquet(str(tmp_path / "in")), 12), tmp_path, "ck")
    # two seconds of ten rows a batch: ten of the first batch, two of the second, none of the third
    assert sorted(r.id for r in found) == sorted([i * 10 for i in range(20)] + [1, 11, 101, 111])


# --- SQL

GOOD = ["SELECT 1", "with x as (select 1) select * from x;", "select updated_at, 'DROP; it' from t -- ; delete", "SELECT drop_rate FROM t"]
BAD = ["", "INSERT INTO t VALUES (1)", "DROP TABLE t", "SELECT * INTO x FROM t", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE x;",
       "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECTED", "EXPLAIN SELECT 1", "select 1 union truncate"]


def test_sql_guard():
    for text in GOOD:
        q.validate_sql(text)
    for text in BAD:
        with pytest.raises(ValueError):
            q.validate_sql(text)
    q.validate_sql_strict("select 1")
    with pytest.raises(ValueError):
        q.validate_sql_strict("with x as (select 1) select * from x")


def test_table_names():
    text = "SELECT 7.5, '7.events_v1' FROM 7.events_v1 e JOIN 7.context_v1 ON 7.other = 1"
    assert q.normalise_table_names(text, 7) == "SELECT 7.5, '7.events_v1' FROM events_v1 e JOIN context_v1 ON 7.other = 1"
    with pytest.raises(ValueError):
        q.normalise_table_names("SELECT * FROM 8.events_v1", 7)


def test_workspaces_are_apart(spark, tmp_path):
    base = str(tmp_path)
    data = "SELECT id, id % 2 + 1 AS workspace_id, concat('e', id) AS event_name FROM range(20)"
    spark.sql(data).write.partitionBy("workspace_id").parquet(f"{base}/events_v1")
    one, two = (q.Workspace.of_lake(spark, base, w) for w in (1, 2))
    assert one.run_sql("SELECT min(id) AS i FROM events_v1").first().i == 0
    assert two.run_sql("SELECT min(id) AS i FROM 2.events_v1").first().i == 1
    assert one.run_sql("SELECT * FROM events_v1 LIMIT 9", limit=3).count() == 9
    assert one.run_sql("SELECT * FROM (SELECT * FROM events_v1 LIMIT 9)", limit=3).count() == 3
    for text in (f"SELECT * FROM parquet.`{base}/events_v1`", "SELECT * FROM 2.events_v1", "SELECT * FROM nowhere"):
        with pytest.raises(Exception):
            one.run_sql(text)
    values = one.field_values("events", "event_name", "1", 3)
    assert [v[0] for v in values.collect()] == ["e10", "e12", "e14"]
    for source, field, search in (("x", "y", None), ("events", "payload", None), ("events", "event_name", "a'b"), ("events", "event_name", "a" * 101)):
        with pytest.raises(ValueError):
            one.field_values(source, field, search)


def test_catalogue_and_rendering(rows):
    assert set(q.list_sources()) == {"events", "logs", "context", "user_traits", "users", "user_devices"}
    assert q.list_fields("logs")["level"] == "String"
    with pytest.raises(ValueError):
        q.list_fields("x")
    df = rows([("a,b", 1), ('c"d', None)], "name string, n int")
    wide = rows([("x" * 80, 1)], "name string, n int")

    def lines(df, fmt="table"):
        return [r.text for r in q.render(df, fmt).collect()]

    assert lines(df, "csv") == ['"a,b",1', '"c\\"d",'] and q.heading(df, "csv") == "name,n"
    assert lines(df, "json") == ['{"name":"a,b","n":1}', '{"name":"c\\"d"}']
    assert lines(df) == ["a,b  | 1   ", 'c"d  | NULL'] and q.heading(df) == "name | n   "
    assert lines(wide) == ["x" * 80 + " | 1"] and lines(df.limit(0)) == []
    with pytest.raises(ValueError):
        q.render(df, "xml")


# --- rollups

AS_OF = datetime(2024, 3, 10, 12)


def test_order_figures(rows):
    df = rows(
        [(datetime(2024, 3, 10, 1), "10.10"), (datetime(2024, 2, 20), "n/a"), (datetime(2024, 3, 1), "0.20"), (datetime(2023, 1, 1), "99")],
        "created_at timestamp, total_price string",
    )
    assert tuple(c.order_counts(df, AS_OF).first()) == (4, 1, 3)
    assert tuple(c.revenue(df, AS_OF).first()) == (10.1, 10.3)
    assert c.avg_order_value(df, AS_OF).first()[0] == pytest.approx(10.3 / 3)
    assert c.avg_order_value(df, datetime(2020, 1, 1)).first()[0] == 0.0


def test_refund_figures(spark):
    df = spark.sql(
        """SELECT timestamp'2024-03-09 00:00:00' AS created_at, array(
            named_struct('transactions', array(named_struct('amount', '5.5'), named_struct('amount', 'x'))),
            named_struct('transactions', CAST(array() AS array<struct<amount:string>>))) AS refunds
        UNION ALL SELECT timestamp'2023-03-09 00:00:00', array(named_struct('transactions', array(named_struct('amount', '7'))))"""
    )
    assert tuple(c.refunds(df, AS_OF).first()) == (2, 5.5)


def test_repository_figures(rows):
    facts = rows([("r", 1, 5, 1, 1, 1, 9, "old"), ("r", 2, 7, 2, 2, 2, 9, "main")],
                 "entity string, updated_at int, stars int, forks int, watchers int, open_issues int, size_kb int, default_branch string")
    assert tuple(c.repo_facts(facts).first()) == ("r", 7, 2, 2, 2, 9, "main")
    issues = rows([("r", False, "open", False), ("r", True, "closed", True), ("r", True, "closed", False), ("r", True, "open", None)],
                  "entity string, is_pull_request boolean, state string, merged boolean")
    assert tuple(c.issue_counts(issues).first()) == ("r", 1, 0, 1, 2, 1)
    commits = rows([("r", datetime(2024, 3, 1)), ("r", datetime(2023, 3, 1))], "entity string, committed_at timestamp")
    assert tuple(c.commit_stats(commits, AS_OF).first()) == ("r", 1, datetime(2024, 3, 1))
    chosen = c.select_metrics(c.repo_facts(facts), ["stars", "default_branch"])
    assert c.to_snapshots(chosen, "git", AS_OF).first().metrics == '{"stars":7,"default_branch":"main"}'
    assert c.select_metrics(facts, None) is facts


def test_stock_and_checkouts(rows):
    assert tuple(c.inventory(rows([(-5,), (3,), (10,), (None,), (0,)], "available int")).first()) == (13, 1)
    assert c.abandoned(rows([(None,), (AS_OF,)], "completed_at timestamp")).first()[0] == 1
    orders = rows([("open", None), ("open", "fulfilled"), ("closed", None)], "status string, fulfillment_status string")
    assert c.unfulfilled(orders).first()[0] == 1
