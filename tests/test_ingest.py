import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalspark.functions import normalize as n
from signalspark.functions.jsondoc import json_depth, too_deep
from signalspark.operators import tables as t
from signalspark.operators.routing import Rule, for_sink, route
from signalspark.schema import NIL_UUID, Frames
from signalspark.sinks import files
from signalspark.sources import jsonl, lake

DEVICE = "0A1B2C3D-0000-4000-8000-00000000000f"
PLAIN = DEVICE.lower()


def event(**fields):
    return json.dumps({"type": "track", "device_id": DEVICE, "timestamp": 1000, **fields})


def parsed(rows, *lines):
    good, bad = jsonl.parse_event_lines(rows([(line,) for line in lines], "value string"), 5)
    return good.collect(), {r.line: r.error for r in bad.collect()}


def test_event_lines(rows):
    good, bad = parsed(rows, event(event="buy", session_id=DEVICE.replace("-", "")), "", " \t", '{"type"', event(type=5))
    assert [(r.event_type, r.device_id, r.session_id, r.event_name) for r in good] == [("track", PLAIN, PLAIN, "buy")]
    assert good[0].timestamp == datetime(1970, 1, 1, 0, 0, 1)
    assert bad == {'{"type"': "invalid JSON", event(type=5): "invalid type for `type`, expected a string"}


def test_rejected_lines_name_the_reason(rows):
    lines = {
        "[1]": "expected an object",
        '{"a":1} x': "invalid JSON",
        '{"device_id":"x"}': "missing field `type`",
        '{"type":"track"}': "missing field `device_id`",
        event(device_id="xyz"): "`device_id` must be a valid UUID",
        event(timestamp=-1): "invalid type for `timestamp`",
        event(timestamp="1"): "invalid type for `timestamp`",
        event(session_id=7): "invalid type for `session_id`",
        event(event=[]): "invalid type for `event`",
        '{"a":' + "[" * 32 + "]" * 32 + "}": "JSON nesting exceeds maximum depth of 32",
    }
    good, bad = parsed(rows, *lines)
    assert good == [] and bad == lines


def test_optional_fields_may_be_null(rows):
    good, bad = parsed(rows, event(event=None, session_id="broken", timestamp=None, properties=None, traits=3, context=None))
    assert bad == {}
    assert (good[0].session_id, good[0].event_name, good[0].payload) == (None, None, "{}")
    assert good[0].timestamp == datetime(1970, 1, 1, 0, 0, 0, 5000)


def test_payload_merge_order(rows):
    line = event(user_id="u", group_id="g", properties={"b": 1, "user_id": "p", "z": [1.50, None]},
                 traits={"b": 2, "a": {"y": 1, "x": 2}}, context={"os": "x"})
    good, _ = parsed(rows, line)
    assert good[0].payload == '{"_context":{"os":"x"},"a":{"x":2,"y":1},"b":2,"group_id":"g","user_id":"p","z":[1.5,null]}'
    assert json.loads(good[0].traits) == {"b": 2, "a": {"y": 1, "x": 2}}


def test_log_lines(rows):
    lines = [
        json.dumps({"message": "hello"}),
        json.dumps({"message": "x", "level": "CRIT", "type": "Enrich", "data": {"message": "y", "k": True}}),
        json.dumps({"level": "info"}),
        json.dumps({"message": "x", "level": None}),
    ]
    good, bad = jsonl.parse_log_lines(rows([(line,) for line in lines], "value string"), 5)
    assert [(r.event_type, r.level, r.payload) for r in good.collect()] == [
        ("log", "info", '{"message":"hello"}'),
        ("enrich", "fatal", '{"k":true,"message":"y"}'),
    ]
    assert sorted(r.error for r in bad.collect()) == ["invalid type for `level`", "missing field `message`"]


def test_depth_ignores_strings(rows):
    cases = [("{}", 1), ('{"a":"{[\\"[{"}', 1), ("[[[]]]", 3), ("", 0), ("]]][", 1), ('["' + "\\\\" * 9000 + '"]', 1)]
    df = rows(cases, "line string, depth int").select(json_depth(F.col("line")).alias("got"), "depth")
    assert [(r.got, r.depth) for r in df.collect()] == [(d, d) for _, d in cases]
    line = F.lit('"' + "[" * 40 + '"')
    assert df.select(too_deep(line, 32)).first()[0] is False


def test_syslog_lines_stay_unparsed(rows):
    row = jsonl.parse_syslog_lines(rows([("<34>Oct 11 su: failed",)], "value string"), 7, "10.0.0.1").first()
    assert (row.payload, row.level, row.session_id, row.source_ip) == ("<34>Oct 11 su: failed", "info", NIL_UUID, "::ffff:10.0.0.1")


def test_snapshots(rows):
    lines = ['{"connector":"shop","entity":"e","metrics":{"b":1,"a":2}}', '{"source":"git","entity":"r"}',
             '{"connector":"","entity":"e"}', '{"connector":"shop"}', "no json"]
    got = jsonl.parse_snapshots(rows([(line,) for line in lines], "value string"), 7).collect()
    assert [(r.connector, r.entity, r.metrics) for r in got] == [("shop", "e", '{"a":2,"b":1}'), ("git", "r", "{}")]


def test_message_text(rows):
    cases = [('{"message":5,"msg":"m"}', "m"), ('{"event":"e","text":"t"}', "t"), ('{"x":1}', '{"x":1}'), ("raw", "raw"), ("", ""), (None, "")]
    got = jsonl.message_text(rows(cases, "payload string, wanted string")).collect()
    assert [r.message for r in got] == [w for _, w in cases]


def test_user_ids_match_uuid5(rows):
    emails = [" User@Example.com ", "user@example.com", "ünï@exämple.de", "", "  ", None]
    got = [r[0] for r in rows([(e,) for e in emails], "e string").select(n.user_id_from_email(F.col("e"))).collect()]
    wanted = str(uuid.uuid5(uuid.NAMESPACE_DNS, "user@example.com"))
    assert got == [wanted, wanted, str(uuid.uuid5(uuid.NAMESPACE_DNS, "ünï@exämple.de")), "", "", ""]


def test_client_ip(rows):
    df = rows(
        [("9.9.9.9", "1.2.3.4, 5.6.7.8", "7.7.7.7"), (None, "nonsense, 5.6.7.8", "7.7.7.7"), ("bad", None, "7.7.7.7"),
         (None, " ::1 ", "7.7.7.7"), (None, "01.2.3.4", "7.7.7.7"), (None, "1:2:3:4:5:6:7::", "7.7.7.7"), (None, "1::2::3", "7.7.7.7")],
        "fwd string, xff string, conn string",
    )
    columns = F.col("fwd"), F.col("xff"), F.col("conn")
    plain = [r[0] for r in df.select(n.client_ip(*columns)).collect()]
    assert plain == ["1.2.3.4", "7.7.7.7", "7.7.7.7", "::1", "7.7.7.7", "1:2:3:4:5:6:7::", "7.7.7.7"]
    trusted = [r[0] for r in df.select(n.client_ip(*columns, forwarding=True)).collect()]
    assert trusted[:3] == ["9.9.9.9", "7.7.7.7", "7.7.7.7"]


@pytest.fixture
def events(rows):
    ts = datetime(2024, 1, 1)
    return rows(
        [
            ("identify", ts, PLAIN, None, None, '{"email":" A@b.c ","name":"Ann","traits":{"plan":"pro","age":5}}'),
            ("identify", ts, None, None, None, '{"email":"a@B.c"}'),
            ("identify", ts, PLAIN, None, None, '{"name":"nobody"}'),
            ("track", ts, None, None, None, '{"k":1}'),
            ("context", ts, PLAIN, PLAIN, None, '{"locale":"en_US.UTF","city":"Oslo"}'),
            ("alias", ts, PLAIN, None, None, "{}"),
        ],
        "event_type string, timestamp timestamp, device_id string, session_id string, event_name string, payload string",
    ).withColumns({"source_ip": F.lit("10.0.0.1"), "workspace_id": F.lit(4)})


def test_typed_tables(events):
    users = t.to_users(events).collect()
    wanted = str(uuid.uuid5(uuid.NAMESPACE_DNS, "a@b.c"))
    assert {(u.user_id, u.name) for u in users} == {(wanted, "Ann"), (wanted, "")}
    assert [d.device_id for d in t.to_user_devices(events).collect()] == [PLAIN]
    assert {(r.trait_key, r.trait_value) for r in t.to_user_traits(events).collect()} == {("plan", "pro"), ("age", "5")}
    track = t.to_events(events).first()
    assert (track.event_name, track.device_id, track.properties, track.source_ip) == ("", NIL_UUID, '{"k":1}', "::ffff:10.0.0.1")
    context = t.to_context(events).first()
    assert (context.locale, context.city, context.country) == ("en_US", "Oslo", "")
    assert [r.event_type for r in t.unsupported(events).collect()] == ["alias"]


def test_write_and_scan_tables(spark, events, tmp_path):
    base = str(tmp_path)
    for _ in range(2):  # a repeated batch replaces itself
        files.write_tables(base, events=events, batch="three")
    assert lake.scan_table(spark, base, 4, "users_v1").count() == 2
    assert lake.scan_table(spark, base, 5, "users_v1").count() == 0
    assert set(lake.open_tables(spark, base)) == set(t.EVENT_TABLES)
    plan = lake.scan_table(spark, base, 4, "events_v1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan
    assert lake.register_tables(spark, base, 4) == list(lake.open_tables(spark, base))
    assert ("city", "string") in lake.list_tables(spark, base)["context_v1"]
    with pytest.raises(FileNotFoundError):
        lake.scan_table(spark, base, 4, "logs_v1")
    with pytest.raises(FileNotFoundError):
        lake.register_tables(spark, base + "/nothing", 4)


def test_parquet_layout(spark, events, tmp_path):
    now = datetime(2025, 1, 15, 10, 30)
    mixed = events.withColumn("workspace_id", F.when(F.col("event_type") != "alias", F.lit(4)).otherwise(F.lit(0)))
    files.write_parquet(mixed, str(tmp_path / "h"), now=now)
    files.write_parquet(mixed, str(tmp_path / "d"), rotation="daily", codec="none", now=now)
    assert (tmp_path / "h/workspace_id=4/date=2025-01-15/hour=10").is_dir()
    assert list((tmp_path / "d/workspace_id=4/date=2025-01-15").glob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 5 and back.columns[0] == "timestamp" and "payload" == back.columns[-4]
    with pytest.raises(ValueError):
        files.write_parquet(events, str(tmp_path), rotation="weekly")


def test_text_lines(spark, events, tmp_path):
    odd = events.where("event_type = 'track'").withColumn("payload", F.lit("a\tb\\c\nd\x01\x9fe"))
    now = datetime(2025, 1, 15, 10, 30, 45, 123000)
    files.write_text(odd, str(tmp_path), now=now)
    line = spark.read.text(str(tmp_path / "events")).first().value
    assert line == (
        "[2025-01-15T10:30:45.123Z] [TRACK] device_id=- session_id=- event_name=- timestamp=1704067200000"
        " source_ip=::ffff:10.0.0.1 payload=a\\tb\\\\c\\nd\\x01\\x9fe"
    )
    assert (tmp_path / "events/workspace_id=4/date=2025-01-15").is_dir()


def test_other_sinks(events, capfd):
    files.write_noop(events)
    files.write_console(events.select("event_type"), 2)
    assert "identify" in capfd.readouterr().out
    calls = []

    def flaky(batch, batch_id):
        calls.append(batch_id)
        if len(calls) < 3:
            raise RuntimeError("not yet")

    files.retrying(flaky, attempts=3, delay=0)(events, 9)
    assert calls == [9, 9, 9]
    with pytest.raises(ZeroDivisionError):
        files.retrying(lambda b, i: 1 / 0, attempts=2, delay=0)(events, 1)
    assert callable(files.jdbc_writer({"url": "jdbc:none", "dbtable": "t"}))


def test_latest_rows(rows):
    df = rows([("u", 1, "old"), ("u", 3, "new"), ("u", 2, "mid"), ("v", 1, "x")], "user_id string, updated_at int, name string")
    assert {(r.user_id, r.name) for r in t.latest_users(df).collect()} == {("u", "new"), ("v", "x")}


def test_retention(rows):
    df = rows([(datetime(2022, 1, 1),), (datetime(2022, 3, 1),)], "timestamp timestamp")
    assert t.apply_ttl(df, "logs_v1", datetime(2024, 2, 29)).count() == 1
    assert t.apply_ttl(df, "events_v1", datetime(2024, 2, 29)).count() == 2
    assert t.apply_ttl(df, "users_v1", datetime(2094, 2, 28)).count() == 2


def test_routing(rows):
    df = rows([("tcp", "tcp"), ("tcp_debug", "tcp"), ("udp", "syslog"), ("x", "y")], "source string, source_type string")
    rules = [Rule(("both",), "tcp", "tcp"), Rule(("never",)), Rule(("a", "b"), source_type="tcp"), Rule(("late",), source="tcp")]
    found = {r.source: r.sinks for r in route(df, rules).collect()}
    assert found == {"tcp": ["both"], "tcp_debug": ["a", "b"]}
    assert {r.source for r in for_sink(route(df, rules, ["rest"]), "rest").collect()} == {"udp", "x"}


def test_timeline_and_context_join(rows):
    at = datetime(2024, 1, 1)
    events = rows([(at, "s", "e1", "d"), (at, "t", "e2", "d")], "timestamp timestamp, session_id string, event_name string, device_id string")
    spans = rows([(datetime(2023, 1, 1), "s", "span")], "timestamp timestamp, session_id string, name string")
    timeline = t.session_timeline("s", Frames(events=events), spans=spans)
    assert [(r.signal, r.label) for r in timeline.collect()] == [("span", "span"), ("event", "e1")]
    context = rows([(datetime(2023, 1, 1), "d", "old"), (at, "d", "new")], "timestamp timestamp, device_id string, device_type string")
    joined = t.events_with_context(events, context, ["device_type"]).collect()
    assert [r.device_type for r in joined] == ["new", "new"]


def test_lake_keeps_batches_and_prunes_days(spark, tmp_path):
    from signalspark.functions.filters import Filter
    from signalspark.functions.ranges import parse_range
    from signalspark.operators.tables import apply_ttl

    base = str(tmp_path / "lake")
    data = "SELECT id, timestamp_seconds(1704067200 + id * 43200) AS timestamp, 1 AS workspace_id FROM range({}, {})"
    files.write_table(spark.sql(data.format(0, 10)), base, "events_v1")
    files.write_table(spark.sql(data.format(10, 13)), base, "events_v1", "named")
    files.write_table(spark.sql(data.format(10, 13)), base, "events_v1", "named")
    scanned = lake.scan_table(spark, base, 1, "events_v1")
    assert scanned.count() == 13
    period = parse_range("2024-01-03,2024-01-04")
    for df in (Filter(period).apply(scanned), lake.scan_table(spark, base, 1, "events_v1", period)):
        assert sorted(r.id for r in df.collect()) == [4, 5, 6, 7]
    plan = Filter(period).apply(scanned)._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    plan = apply_ttl(scanned, "events_v1", datetime(2029, 1, 4))._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert lake.expire(spark, base, "events_v1", datetime(2029, 1, 4)) == 2
    assert sorted(r.id for r in lake.scan_table(spark, base, 1, "events_v1").collect()) == list(range(4, 13))


def test_streams_land_what_they_reject(spark, tmp_path):
    from signalspark.streaming.jobs import ingest_events

    device = "550e8400-e29b-41d4-a716-446655440000"
    for key, lines in {
        "k1": [f'{{"type":"track","device_id":"{device}","event":"a"}}', "no json", f'{{"type":"group","device_id":"{device}"}}'],
        "k2": [f'{{"type":"track","device_id":"{device}","event":"b"}}', '{"type":"track"}'],
    }.items():
        folder = tmp_path / "in" / f"api_key={key}"
        folder.mkdir(parents=True)
        (folder / "x.jsonl").write_text("\n".join(lines))
    keys = spark.createDataFrame([("k1", 1), ("k2", 2)], "api_key string, workspace_id int")
    base = str(tmp_path / "lake")
    stream = ingest_events(spark, str(tmp_path / "in"), base, str(tmp_path / "cp"), now_ms=1704067200000, keys=keys)
    stream.trigger(availableNow=True).start().awaitTermination()
    assert [lake.scan_table(spark, base, w, "events_v1").first().event_name for w in (1, 2)] == ["a", "b"]
    rejected = spark.read.parquet(f"{base}/_rejected/events").collect()
    assert sorted(r.line for r in rejected) == ["no json", '{"type":"track"}'] and all(r.error for r in rejected)
    unstored = spark.read.parquet(f"{base}/_unstored").collect()
    assert [(r.workspace_id, r.event_type, r.n) for r in unstored] == [(1, "group", 1)]


# --- upkeep of the lake


def logs_by_batch(rows, base, batches, day=1):
    from signalspark.sinks.files import write_table

    for b in range(batches):
        moment = datetime(2024, 1, day, 10, b)
        data = [(7, moment, f"s{b}-{i}", f"m{b}-{i}") for i in range(5)]
        write_table(rows(data, "workspace_id bigint, timestamp timestamp_ntz, session_id string, message string"), base, "logs_v1", f"b{b}")


def test_compaction_gives_the_same_rows_before_during_and_after(spark, rows, tmp_path, monkeypatch):
    from signalspark.sinks import compact
    from signalspark.sources import lake

    base = str(tmp_path / "lake")
    logs_by_batch(rows, base, 4)
    logs_by_batch(rows, base, 2, day=2)
    folder = tmp_path / "lake/logs_v1/workspace_id=7/date=2024-01-01"

    def read():
        got = lake.scan_table(spark, base, 7, "logs_v1").collect()
        opened = lake.open_tables(spark, base)["logs_v1"]
        assert opened.count() == len(got)
        return sorted((str(r.date), r.message) for r in got)

    before = read()
    assert len(before) == 30
    real, calls = compact._hadoop, []

    def breaking(spark, path):  # breaks off when the first old folder is to go
        if "/batch_id=b" in path and "*" not in path:
            calls.append(path)
            raise OSError("lost")
        return real(spark, path)

    monkeypatch.setattr(compact, "_hadoop", breaking)
    with pytest.raises(OSError, match="lost"):
        compact.compact_closed(spark, base, "logs_v1", datetime(2024, 1, 2, 5))
    monkeypatch.setattr(compact, "_hadoop", real)
    assert calls and len(list(folder.glob("batch_id=*"))) == 5 and read() == before
    logs_by_batch(rows, base, 1)  # a batch that was merged comes again
    assert read() == before
    assert compact.compact_closed(spark, base, "logs_v1", datetime(2024, 1, 2, 5)) == 4
    assert read() == before and len(list(folder.glob("batch_id=*"))) == 1 and not list(folder.glob("*/_replaces"))
    assert compact.compact_closed(spark, base, "logs_v1", datetime(2024, 1, 2, 5)) == 0
    assert len(list((tmp_path / "lake/logs_v1/workspace_id=7/date=2024-01-02").glob("batch_id=*"))) == 2


def test_a_look_up_reads_the_row_groups_that_may_hold_the_value(spark, tmp_path):
    from signalspark.sinks.compact import filters_of

    rows = spark.range(0, 200_000, 1, 1).selectExpr("md5(CAST(id % 50000 AS STRING)) AS session_id", "id")
    options = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "100", "parquet.page.row.count.limit": "2000"}

    def scanned(path, options):
        rows.orderBy("session_id").selectExpr("session_id", "id").repartition(1).write.options(**options).parquet(path)
        found = spark.read.parquet(path).where(f"session_id = md5('77') AND id >= 0")
        assert found.count() == 4
        frame = spark.read.parquet(path).where("session_id = md5('nobody')")
        plan = frame._jdf.queryExecution().executedPlan()
        frame.collect()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    plain = scanned(str(tmp_path / "plain"), options)
    assert scanned(str(tmp_path / "filtered"), options | filters_of(["session_id", "id"])) < plain / 2


def test_parsing_is_shared_by_all_tasks_and_identities_are_worked_out_once(spark, rows):
    from signalspark.operators import tables
    from signalspark.sources import jsonl

    line = '{"type":"identify","device_id":"00000001-0000-4000-8000-000000000001","properties":{"email":" A@b.c"},"traits":{"k":"v"}}'
    lines = rows([(line,)] * 8, "value string").coalesce(1)
    assert jsonl.check_event_lines(lines).rdd.getNumPartitions() == 4
    found = tables.to_users(jsonl.parse_event_lines(lines, 0)[0])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sha1" in line for line in plan.splitlines() if "Filter" in line)
    assert {(r.email, len(r.user_id)) for r in found.collect()} == {(" A@b.c", 36)} and found.count() == 8
