from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalspark.functions.buckets import bucket, bucket_offset, parse_granularity
from signalspark.functions.filters import (
    Condition,
    Filter,
    field_column,
    parse_compare,
    parse_conditions,
    parse_operator,
)
from signalspark.functions.ranges import Range, parse_range

NOW = datetime(2024, 5, 31, 10, 20, 30)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("today", "2024-05-31", "2024-05-31"),
        ("Yesterday", "2024-05-30", "2024-05-30"),
        ("wtd", "2024-05-27", "2024-05-31"),
        ("mtd", "2024-05-01", "2024-05-31"),
        ("qtd", "2024-04-01", "2024-05-31"),
        ("ytd", "2024-01-01", "2024-05-31"),
        ("7d", "2024-05-25", "2024-05-31"),
        ("1h", "2024-05-31", "2024-05-31"),
        ("24h", "2024-05-30", "2024-05-31"),
        ("2w", "2024-05-18", "2024-05-31"),
        ("3m", "2024-02-29", "2024-05-31"),
        ("12M", "2023-05-31", "2024-05-31"),
        ("5m", "2024-01-03", "2024-05-31"),
        ("1y", "2023-06-02", "2024-05-31"),
        (" 2024-01-01 , 2024-01-31 ", "2024-01-01", "2024-01-31"),
    ],
)
def test_named_relative_and_explicit_ranges(text, start, end):
    found = parse_range(text, NOW)
    assert found.start == datetime.fromisoformat(start)
    assert found.end == datetime.fromisoformat(end + "T23:59:59")


@pytest.mark.parametrize("text", ["", "0d", "-3d", "7x", "soon", "2024-01-01", "2024-02-30,2024-03-01", "2024-02-01,2024-01-01"])
def test_bad_ranges(text):
    with pytest.raises(ValueError):
        parse_range(text, NOW)


def test_comparison_periods():
    june = parse_range("2024-06-01,2024-06-30")
    assert june.previous_period() == Range(datetime(2024, 5, 2), datetime(2024, 5, 31, 23, 59, 59))
    leap = parse_range("2024-02-29,2024-03-01").previous_year()
    assert leap == Range(datetime(2024, 2, 29), datetime(2023, 3, 1, 23, 59, 59))
    assert june.previous_year().start == datetime(2023, 6, 1)
    assert june.days() == 30
    assert june.duration().days == 29


def test_range_end_is_the_last_full_second(rows):
    df = rows([(datetime(2024, 5, 31, 23, 59, 59),), (datetime(2024, 5, 31, 23, 59, 59, 1),)], "timestamp timestamp")
    assert df.where(parse_range("today", NOW).predicate(df)).count() == 1


def test_range_predicate_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = df.where(parse_range("2024-01-03,2024-01-04").predicate(df, "ts")).select("event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_granularity_names():
    assert [parse_granularity(t) for t in ("MIN", "1h", "1d", "week", "month", "quarter", "1y")] == [
        "minute", "hourly", "daily", "weekly", "monthly", "quarterly", "yearly",
    ]
    with pytest.raises(ValueError):
        parse_granularity("decade")
    assert bucket(None, F.lit(None)) is None


def test_bucket_offsets(rows):
    df = rows([(datetime(2024, 3, 14, 5, 30),)], "t timestamp_ntz")
    origin = datetime(2023, 12, 30)
    for granularity, wanted in (
        ("hourly", 75 * 24 + 5), ("daily", 75), ("weekly", 11), ("monthly", 3), ("quarterly", 1), ("yearly", 1),
    ):
        got = df.select(bucket_offset(granularity, bucket(granularity, F.col("t")), origin)).first()[0]
        assert got == wanted, granularity


def test_operator_spellings():
    assert parse_operator("<>") == "ne" and parse_operator("LIKE") == "contains" and parse_operator("~") == "regex"
    assert parse_compare("yoy") == "previous_year"
    for parse in (parse_operator, parse_compare):
        with pytest.raises(ValueError):
            parse("almost")


def test_mismatched_conditions_raise(rows):
    df = rows([("a", "1.2.3.4")], "x string, source_ip string")
    for condition in (
        Condition("x", "in", "a"),
        Condition("x", "eq", ["a"]),
        Condition("x", "eq"),
        Condition("source_ip", "contains", "1"),
        Condition("nowhere", "eq", "a"),
    ):
        with pytest.raises(ValueError):
            condition.to_column(df)


def test_missing_values_pass_only_is_not_set(rows):
    df = rows([(None,), ("a",)], "x string")
    for operator, value, kept in (
        ("ne", "b", ["a"]), ("not_in", ["b"], ["a"]), ("not_contains", "b", ["a"]), ("is_not_set", None, [None]),
    ):
        got = [r.x for r in df.where(Condition("x", operator, value).to_column(df)).collect()]
        assert got == kept, operator


def test_values_are_never_read_as_sql(rows):
    df = rows([("a' OR '1'='1",), ("b",), ("50%_",)], "x string")
    hostile = Condition("x", "eq", "a' OR '1'='1")
    assert df.where(hostile.to_column(df)).count() == 1
    assert df.where(Condition("x", "contains", "%_").to_column(df)).count() == 1
    with pytest.raises(ValueError):
        field_column(df, "x; DROP TABLE y")


def test_nested_json_path(rows):
    df = rows([('{"a":{"b c":{"d":"v"}},"a.b":1}',)], "properties string")
    assert df.select(field_column(df, "properties.a.b c.d")).first()[0] == "v"


def test_flattened_conditions():
    found = parse_conditions(
        {
            "conditions[1][field]": "country",
            "conditions[1][operator]": "in",
            "conditions[1][value][]": ["DE", "FR"],
            "conditions[0][field]": "level",
            "conditions[0][value]": "error",
            "conditions[2][field]": "name",
            "conditions[2][operator]": "is_set",
            "conditions[3][operator]": "eq",
            "conditions[4][field]": "left out",
            "range": "7d",
        }
    )
    assert found == [
        Condition("level", "eq", "error"),
        Condition("country", "in", ["DE", "FR"]),
        Condition("name", "is_set", None),
    ]


def test_filter_defaults_and_limit():
    f = Filter()
    assert f.granularity == "daily" and f.time_range.days() == 30
    assert f.with_limit(50_000).limit == 50_000
    assert Filter.over("7d", NOW, limit=5, compare="prev").comparison().limit is None
