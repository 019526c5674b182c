from datetime import date, datetime

import pytest

from signalspark.functions.filters import Condition, Filter
from signalspark.operators import aggregates as agg
from signalspark.operators import metrics as m
from signalspark.plans.specs import MetricSpec, run_series, run_spec
from signalspark.schema import Frames

WEEK = Filter.over("2024-01-01,2024-01-07")


@pytest.fixture
def frames(rows):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    context = rows(
        [(day(1), "a", "s1", "phone"), (day(1, 5), "a", "s1", "phone"), (day(1), "b", "s2", "web"), (day(3), "a", "s3", "phone")],
        "timestamp timestamp_ntz, device_id string, session_id string, device_type string",
    )
    events = rows(
        [(day(1), "buy", "a", '{"p":"2.5"}'), (day(1), "buy", "b", '{"p":"x"}'), (day(2), "view", "a", '{}')],
        "timestamp timestamp_ntz, event_name string, device_id string, properties string",
    )
    return Frames(context=context, events=events)


def points(df):
    return sorted(tuple(r) for r in df.collect())


def test_distinct_devices(frames):
    assert points(m.dau(frames, WEEK)) == [(date(2024, 1, 1), 2.0), (date(2024, 1, 3), 1.0)]
    assert points(m.sessions(frames, WEEK)) == [(date(2024, 1, 1), 3.0), (date(2024, 1, 3), 1.0)]


def test_filter_breakdown_is_honoured(frames):
    f = Filter.over("2024-01-01,2024-01-07", granularity=None, breakdown="device_type")
    assert points(m.dau(frames, f)) == [("phone", 1.0), ("web", 1.0)]


def test_custom_metric_ignores_what_is_no_number(frames):
    f = Filter.over("2024-01-01,2024-01-07", granularity=None)
    for fn, wanted in (("sum", 2.5), ("avg", 2.5), ("count", 1.0), ("MAX", 2.5)):
        assert points(m.custom_event_metric(frames, f, "buy", "properties.p", fn)) == [(wanted,)]
    with pytest.raises(ValueError):
        m.custom_event_metric(frames, f, "buy", "properties.p", "median")


def test_empty_series_gives_zeros(frames):
    nothing = m.event_count(frames, WEEK, name="never")
    assert tuple(agg.series_stats(nothing).first()) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("now, before, change, percent", [(5, 0, 5, 100), (0, 0, 0, 0), (15, 10, 5, 50), (0, 4, -4, -100)])
def test_comparison_arithmetic(rows, now, before, change, percent):
    current, previous = (rows([(float(v),)] if v else [], "value double") for v in (now, before))
    found = agg.compare(current, previous).first()
    assert (found.change, found.percent_change) == (change, percent)


def test_comparison_with_points_lines_buckets_up(frames):
    f = Filter.over("2024-01-03,2024-01-04", compare="previous")
    found = points(m.with_comparison(m.dau, frames, f, with_points=True).select("period", "bucket_offset", "value"))
    assert found == [("current", 0, 1.0), ("previous", 0, 2.0)]


def test_stickiness(frames):
    share = points(m.stickiness_share(frames, WEEK))
    assert [round(v, 3) for _, v in share] == [66.667, 33.333]
    ratio = dict(points(m.stickiness_ratio(frames, Filter.over("2024-01-01,2024-01-05"), den_days=3)))
    # Day 4: only device a was seen in the last three days, and nobody on the day itself.
    assert ratio == {date(2024, 1, d): v for d, v in ((1, 100.0), (2, 0.0), (3, 50.0), (4, 0.0), (5, 0.0))}


def test_to_points_names_columns(rows):
    df = rows([(1, "x", 2)], "hour int, city string, count bigint")
    assert tuple(agg.to_points(df).first()) == (1, 2.0, "x")


def test_specs(frames):
    spec = MetricSpec("dau", "2024-01-01,2024-01-07", (Condition("device_type", "eq", "web"),))
    assert points(run_spec(frames, spec)) == [(date(2024, 1, 1), 1.0)]
    top = MetricSpec("top_events", "2024-01-01,2024-01-07", limit=1)
    assert points(run_spec(frames, top)) == [("buy", 2.0)]
    both = run_series(frames, {"one": spec, "two": MetricSpec("events", "2024-01-01,2024-01-07")})
    assert {r.series for r in both.collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        run_series(frames, {})
    with pytest.raises(ValueError):
        run_series(frames, {str(i): spec for i in range(21)})
    with pytest.raises(ValueError):
        run_spec(frames, MetricSpec("luck", "7d"))
    compared = MetricSpec("dau", "2024-01-03,2024-01-04", compare_mode="prev")
    assert {r.period for r in run_spec(frames, compared).collect()} == {"current", "previous"}


def test_missing_table_is_named(frames):
    with pytest.raises(ValueError, match="logs"):
        m.log_volume(frames, WEEK)


def test_a_board_gives_each_series_points_in_one_scan(spark, frames, tmp_path):
    for name in ("context", "events"):
        frames.get(name).write.parquet(str(tmp_path / name))
    stored = Frames(**{name: spark.read.parquet(str(tmp_path / name)) for name in ("context", "events")})
    week = "2024-01-01,2024-01-07"
    specs = {
        "a": MetricSpec("dau", week), "b": MetricSpec("sessions", week, breakdown="device_type"),
        "c": MetricSpec("unique_sessions", week, granularity="hourly", limit=2), "d": MetricSpec("stickiness", week),
        "e": MetricSpec("events", week, filters=(Condition("event_name", "eq", "buy"),)),
        "f": MetricSpec("top_events", week, limit=1), "g": MetricSpec("dau", "2024-01-03,2024-01-04", compare_mode="prev"),
        "h": MetricSpec("events", "2020-01-01,2020-01-02"), "i": MetricSpec("top_sessions", week),
    }
    board = run_series(stored, specs)
    plan = board._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    got = {name: [] for name in specs}
    for r in board.collect():
        got[r.series].append((str(r.date)[:10] if r.date else None, r.value, r.dimension, r.period, r.bucket_offset))

    def plain(row):
        row = row.asDict()
        date = row.get("date")
        return (str(date)[:10] if date else None, row["value"], row.get("dimension"), row.get("period"), row.get("bucket_offset"))

    for name, spec in specs.items():
        assert sorted(got[name], key=str) == sorted(map(plain, run_spec(stored, spec).collect()), key=str), name


def test_sketches_stay_within_two_percent_and_small_counts_are_exact(spark):
    from signalspark.functions.filters import Filter
    from signalspark.operators import sketches

    days = "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 10 AS INT))"
    rows = spark.range(300_000).selectExpr(f"{days} AS timestamp", "CAST(pmod(hash(id), 60000) AS STRING) AS device_id", "CAST(id % 2 AS STRING) AS kind")
    stored = sketches.daily_sketches(rows, "device_id", "kind")
    f = Filter.over("2024-01-01,2024-01-10")
    for split in (None, "kind"):
        exact = {tuple(r[:-1]): r[-1] for r in agg.count_distinct_query(rows, "device_id", f, by=split).collect()}
        got = {tuple(r[:-1]): r[-1] for r in sketches.distinct_from_sketches(stored, f, split is not None).collect()}
        assert set(got) == set(exact) and all(abs(got[k] / exact[k] - 1) < 0.02 for k in exact)
    whole = Filter.over("2024-01-01,2024-01-10", granularity=None)
    exact = agg.count_distinct_query(rows, "device_id", whole).first().value
    assert abs(sketches.distinct_from_sketches(stored, whole).first().value / exact - 1) < 0.02
    few = rows.where("CAST(device_id AS INT) < 200")
    last = Filter.over("2024-01-05,2024-01-10")
    got = {r.date.day: r.value for r in sketches.rolling_from_sketches(sketches.daily_sketches(few, "device_id"), last, 3).collect()}
    for day in range(5, 11):
        window = few.where(f"date(timestamp) BETWEEN date '2024-01-{day - 2:02d}' AND date '2024-01-{day:02d}'")
        assert got[day] == window.select("device_id").distinct().count()
    with pytest.raises(ValueError):
        sketches.distinct_from_sketches(stored, Filter.over("2024-01-01,2024-01-10", granularity="hourly"))
