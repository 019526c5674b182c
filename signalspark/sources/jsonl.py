"""JSON-lines, syslog and snapshot ingest, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions import normalize as n
from signalspark.functions.jsondoc import (
    Scalar,
    computed_once,
    object_at,
    single_entry,
    too_deep,
    value_at,
    with_document,
    with_fields,
    with_object,
)
from signalspark.schema import NIL_UUID
from signalspark.session import spread

MAX_JSON_DEPTH = 32


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text lines as ``value``; works on a folder of files, as a batch or as a stream."""
    return (spark.readStream if streaming else spark.read).text(path)


def _checked(lines: DataFrame, required: list[str], optional: list[str], plain: list[str], objects: list[str],
             device: bool) -> DataFrame:
    """Non-blank lines with their fields as ``_doc`` and the reason for rejecting them, if any, as ``_error``.

    Each line is parsed once, into a struct of VARIANT fields, which keep their JSON types.
    ``plain`` fields may be left out but not be null.
    """
    filled = spread(lines.where(~F.col("value").rlike(r"^[ \t\n\x0B\f\r]*\z")))
    deep = too_deep(F.col("value"), MAX_JSON_DEPTH)
    names = [*required, *optional, *plain, "timestamp", *objects]
    # A line that nests too deeply is not handed to the parser at all.
    parsed = with_fields(filled, F.when(~deep, F.col("value")), names, deep.alias("_deep"))
    tests = [
        (F.col("_deep"), f"JSON nesting exceeds maximum depth of {MAX_JSON_DEPTH}"),
        (F.col("_complete").isNull(), "invalid JSON"),
        (F.col("_doc").isNull(), "expected an object"),
    ]

    def kind(name: str) -> Column:
        return F.schema_of_variant(f"_doc.{name}")

    for name in required:
        tests.append((F.col(f"_doc.{name}").isNull(), f"missing field `{name}`"))
        tests.append((kind(name) != "STRING", f"invalid type for `{name}`, expected a string"))
    for name in optional:
        tests.append((~kind(name).isin("STRING", "VOID"), f"invalid type for `{name}`"))
    for name in plain:
        tests.append((kind(name) != "STRING", f"invalid type for `{name}`"))
    natural = (kind("timestamp") == "VOID") | ((kind("timestamp") == "BIGINT") & (_stamp() >= 0))
    tests.append((~natural, "invalid type for `timestamp`"))
    if device:
        tests.append((n.norm_uuid(_text("device_id")).isNull(), "`device_id` must be a valid UUID"))
    error = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        error = F.when(test, F.lit(reason)).otherwise(error)
    return computed_once(parsed, error.alias("_error"))


def _text(name: str) -> Column:
    return F.try_variant_get(f"_doc.{name}", "$", "string")


def _stamp() -> Column:
    return F.try_variant_get("_doc.timestamp", "$", "bigint")


def _object(name: str) -> Column:
    return F.try_variant_get(f"_doc.{name}", "$", "map<string,variant>")


def build_payload(df: DataFrame) -> DataFrame:
    """Add ``payload``: ids, then properties, then traits (later ones win), the context nested; keys sorted."""
    context = F.col("_doc.context")
    given = F.coalesce(F.schema_of_variant(context) != "VOID", F.lit(False))
    return with_object(
        df,
        "payload",
        {
            "user": single_entry("user_id", _text("user_id")),
            "group": single_entry("group_id", _text("group_id")),
            "properties": _object("properties"),
            "traits": _object("traits"),
            "context": F.when(given, F.create_map(F.lit("_context"), context)),
        },
    )


def build_log_payload(df: DataFrame) -> DataFrame:
    """Add ``payload``: the message, then the fields of ``data``, which may replace it; keys sorted."""
    sources = {"message": single_entry("message", _text("message")), "data": _object("data")}
    return with_object(df, "payload", sources)


def check_event_lines(lines: DataFrame) -> DataFrame:
    """Lines parsed once, for ``events_of`` and ``rejected_of``."""
    return _checked(lines, ["type", "device_id"], ["event", "session_id", "user_id", "group_id"], [],
                    ["properties", "traits", "context"], device=True)


def events_of(checked: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Events. ``traits`` stays beside the payload so that it reaches the trait table."""
    return build_payload(checked.where(F.col("_error").isNull())).select(
        n.norm_event_type(_text("type")).alias("event_type"),
        n.ts_from_ms(_stamp(), now_ms).alias("timestamp"),
        n.norm_uuid(_text("device_id")).alias("device_id"),
        n.norm_uuid(_text("session_id")).alias("session_id"),
        _text("event").alias("event_name"),
        "payload",
        F.to_json(_object("traits")).alias("traits"),
        *_carried(checked),
    )


def check_log_lines(lines: DataFrame) -> DataFrame:
    """Lines parsed once, for ``logs_of`` and ``rejected_of``."""
    return _checked(lines, ["message"], ["source", "service", "session_id"], ["level", "type"], ["data"], device=False)


def logs_of(checked: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Log entries; level info and type log are the defaults."""
    kind = F.lower(F.coalesce(_text("type"), F.lit("log")))
    return build_log_payload(checked.where(F.col("_error").isNull())).select(
        F.when(kind.isin("log", "enrich"), kind).otherwise(F.lit("unknown")).alias("event_type"),
        n.norm_log_level(F.coalesce(_text("level"), F.lit("info"))).alias("level"),
        n.ts_from_ms(_stamp(), now_ms).alias("timestamp"),
        _text("source").alias("source"),
        _text("service").alias("service"),
        n.norm_uuid(_text("session_id")).alias("session_id"),
        "payload",
        *_carried(checked),
    )


def rejected_of(checked: DataFrame) -> DataFrame:
    """The other lines and why they were rejected."""
    return checked.where(F.col("_error").isNotNull()).select(
        F.col("value").alias("line"), F.col("_error").alias("error"), *_carried(checked)
    )


def _carried(checked: DataFrame) -> list[str]:
    return [c for c in checked.columns if c != "value" and not c.startswith("_")]


def parse_event_lines(lines: DataFrame, now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and rejected lines."""
    checked = check_event_lines(lines)
    return events_of(checked, now_ms), rejected_of(checked)


def parse_log_lines(lines: DataFrame, now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Log entries and rejected lines."""
    checked = check_log_lines(lines)
    return logs_of(checked, now_ms), rejected_of(checked)


def read_events_jsonl(
    spark: SparkSession, path: str, now_ms: int | None = None, streaming: bool = False
) -> tuple[DataFrame, DataFrame]:
    return parse_event_lines(read_lines(spark, path, streaming), now_ms)


def read_logs_jsonl(
    spark: SparkSession, path: str, now_ms: int | None = None, streaming: bool = False
) -> tuple[DataFrame, DataFrame]:
    return parse_log_lines(read_lines(spark, path, streaming), now_ms)


def parse_syslog_lines(lines: DataFrame, now_ms: int | None = None, source_ip: str | None = None) -> DataFrame:
    """Each line as one unparsed log entry, stamped with its time of receipt."""
    return lines.select(
        F.lit("log").alias("event_type"),
        F.lit("info").alias("level"),
        n.ts_from_ms(F.lit(None).cast("bigint"), now_ms).alias("timestamp"),
        F.lit("").alias("source"),
        F.lit("").alias("service"),
        F.lit(NIL_UUID).alias("session_id"),
        n.norm_ip(F.lit(source_ip)).alias("source_ip"),
        F.col("value").alias("payload"),
        *[c for c in lines.columns if c != "value"],
    )


def read_syslog_text(
    spark: SparkSession, path: str, now_ms: int | None = None, streaming: bool = False
) -> DataFrame:
    return parse_syslog_lines(read_lines(spark, path, streaming), now_ms)


def parse_snapshots(lines: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Connector snapshots; ``source`` stands in for ``connector``; rows without one or an entity are skipped."""
    parsed = with_document(lines, F.col("value"))

    def text(name: str) -> Column:
        field = Scalar(value_at(F.col("_doc"), name))
        return F.when(field.is_string, field.text)

    rows = parsed.select(
        n.ts_from_ms(F.lit(None).cast("bigint"), now_ms).alias("timestamp"),
        F.coalesce(text("connector"), text("source"), F.lit("")).alias("connector"),
        F.coalesce(text("entity"), F.lit("")).alias("entity"),
        F.coalesce(F.to_json(object_at(F.col("_doc"), "metrics")), F.lit("{}")).alias("metrics"),
        *[c for c in lines.columns if c != "value"],
    )
    return rows.where((F.col("connector") != "") & (F.col("entity") != ""))


def read_snapshots(
    spark: SparkSession, path: str, now_ms: int | None = None, streaming: bool = False
) -> DataFrame:
    return parse_snapshots(read_lines(spark, path, streaming), now_ms)


def message_text(df: DataFrame, payload: str = "payload", name: str = "message") -> DataFrame:
    """Add the human-readable part of a payload: its first text field of a known name, else all of it."""
    parsed = with_document(df, F.col(payload))
    # Where a log message is looked for, in order.
    fields = ["message", "msg", "text", "log", "event"]
    found = [Scalar(value_at(F.col("_doc"), field)) for field in fields]
    texts = [F.when(field.is_string, field.text) for field in found]
    return parsed.withColumn(name, F.coalesce(*texts, F.col(payload), F.lit(""))).drop("_doc")


def assign_workspace(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Replace ``api_key`` by the workspace it opens; rows with an unknown key are dropped."""
    known = keys.select("api_key", "workspace_id").dropDuplicates(["api_key"])
    return df.join(known, "api_key").drop("api_key")
