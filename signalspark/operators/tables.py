"""Typed tables from normalised events and logs, current rows, retention, and joins across tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions import normalize as n
from signalspark.functions.jsondoc import computed_once
from signalspark.functions.ranges import since
from signalspark.schema import CONTEXT_FIELDS, RETENTION_YEARS, UNSTORED_TYPES, Frames


def _workspace(df: DataFrame) -> list[str]:
    return ["workspace_id"] if "workspace_id" in df.columns else []


def _source_ip(df: DataFrame) -> Column:
    column = F.col("source_ip") if "source_ip" in df.columns else F.lit(None).cast("string")
    return n.norm_ip(column).alias("source_ip")


def _of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def to_events(df: DataFrame) -> DataFrame:
    """Track events."""
    return _of_type(df, "track").select(
        "timestamp",
        F.coalesce("event_name", F.lit("")).alias("event_name"),
        n.nil_uuid(F.col("device_id")).alias("device_id"),
        n.nil_uuid(F.col("session_id")).alias("session_id"),
        _source_ip(df),
        F.col("payload").alias("properties"),
        F.col("payload").alias("_raw"),
        *_workspace(df),
    )


def to_context(df: DataFrame) -> DataFrame:
    """Context events, with the known payload fields lifted into columns in one parse."""
    lifted = F.from_json("payload", ", ".join(f"{name} string" for name in CONTEXT_FIELDS))
    parsed = _of_type(df, "context").select("*", F.inline(F.array(lifted)))

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        return (n.norm_locale(text) if name == "locale" else text).alias(name)

    return parsed.select(
        "timestamp",
        n.nil_uuid(F.col("device_id")).alias("device_id"),
        n.nil_uuid(F.col("session_id")).alias("session_id"),
        _source_ip(df),
        *[field(name) for name in CONTEXT_FIELDS],
        F.col("payload").alias("properties"),
        *_workspace(df),
    )


def identified(df: DataFrame) -> DataFrame:
    """Identify events that name an email address, with the user id it stands for; each worked out once a row."""
    email = F.coalesce(n.json_str(F.col("payload"), "email"), F.lit(""))
    found = computed_once(_of_type(df, "identify").drop("email", "user_id"), email.alias("email"))
    return computed_once(found, n.user_id_from_email(F.col("email")).alias("user_id")).where(F.col("user_id") != "")


def users_of(found: DataFrame) -> DataFrame:
    return found.select(
        "user_id",
        "email",
        F.coalesce(n.json_str(F.col("payload"), "name"), F.lit("")).alias("name"),
        F.col("timestamp").alias("updated_at"),
        *_workspace(found),
    )


def to_users(df: DataFrame) -> DataFrame:
    return users_of(identified(df))


def user_devices_of(found: DataFrame) -> DataFrame:
    linked = found.where(F.col("device_id").isNotNull())
    return linked.select("user_id", "device_id", F.col("timestamp").alias("linked_at"), *_workspace(found))


def to_user_devices(df: DataFrame) -> DataFrame:
    return user_devices_of(identified(df))


def user_traits_of(found: DataFrame) -> DataFrame:
    """One row per trait: those kept beside the payload, or else the payload's ``traits`` object."""
    inside = n.json_map(F.col("payload"), "traits")
    beside = F.from_json("traits", "map<string,string>") if "traits" in found.columns else F.lit(None)
    traits = F.coalesce(beside, inside) if "traits" in found.columns else inside
    return found.select(
        "user_id",
        F.explode(traits).alias("trait_key", "trait_value"),
        F.col("timestamp").alias("updated_at"),
        *_workspace(found),
    )


def to_user_traits(df: DataFrame) -> DataFrame:
    return user_traits_of(identified(df))


def unsupported(df: DataFrame) -> DataFrame:
    """Events of the types that no table takes."""
    return df.where(F.col("event_type").isin(UNSTORED_TYPES))


def to_logs(df: DataFrame) -> DataFrame:
    """Log entries; a ``pattern_id`` of 0 means that there is none."""
    pattern = F.nullif(F.col("pattern_id"), F.lit(0)) if "pattern_id" in df.columns else F.lit(None)
    return df.select(
        "timestamp",
        F.upper("level").alias("level"),
        n.severity(F.col("level")).alias("severity"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("service", F.lit("")).alias("service"),
        n.nil_uuid(F.col("session_id")).alias("session_id"),
        _source_ip(df),
        pattern.cast("bigint").alias("pattern_id"),
        F.col("payload").alias("message"),
        F.col("payload").alias("_raw"),
        *_workspace(df),
    )


EVENT_TABLES = {
    "events_v1": to_events,
    "context_v1": to_context,
    "users_v1": to_users,
    "user_devices": to_user_devices,
    "user_traits": to_user_traits,
}
#: Those that can be made of what ``identified`` gives, so that it is worked out once for all of them.
IDENTIFIED_TABLES = {"users_v1": users_of, "user_devices": user_devices_of, "user_traits": user_traits_of}


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per key, picked in a partial aggregate before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != version]
    row = F.struct(version, *rest)
    picked = df.groupBy(*keys).agg(F.max(row).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def latest_users(df: DataFrame) -> DataFrame:
    return latest(df, [*_workspace(df), "user_id"], "updated_at")


def latest_patterns(df: DataFrame) -> DataFrame:
    return latest(df, ["pattern_id"], "last_updated")


def oldest_kept(table: str, now: datetime) -> datetime | None:
    """The start of a table's retention; None for tables that keep everything."""
    years = RETENTION_YEARS.get(table)
    if years is None:
        return None
    try:
        return now.replace(year=now.year - years)
    except ValueError:  # 29 February
        return now.replace(year=now.year - years, day=28)


def apply_ttl(df: DataFrame, table: str, now: datetime, ts: str = "timestamp") -> DataFrame:
    """Rows within the table's retention; tables without one keep everything."""
    oldest = oldest_kept(table, now)
    if oldest is None:
        return df
    return df.where(since(df, oldest, ts))


def events_with_context(events: DataFrame, context: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Events with what their device last reported about itself.

    The context side is first brought to one row per device, so a busy device adds no row pairs;
    its many event rows are the streamed side, which AQE may split.
    """
    wanted = columns or ["device_type", "operating_system", "country"]
    device = latest(context.select("device_id", "timestamp", *wanted), ["device_id"], "timestamp").drop("timestamp")
    return events.join(device, "device_id")


def session_timeline(session_id: str | Column, frames: Frames, spans: DataFrame | None = None,
                     metrics: DataFrame | None = None, period: Range | None = None) -> DataFrame:
    """Everything recorded under one session, in order of time; ``period`` bounds what is scanned."""
    sources = {"event": frames.find("events"), "log": frames.find("logs"), "span": spans, "metric": metrics}
    parts = []
    for signal, df in sources.items():
        if df is None:
            continue
        label = {"event": "event_name", "log": "message", "span": "name", "metric": "name"}[signal]
        if period is not None:
            df = df.where(period.predicate(df))
        parts.append(
            df.where(F.col("session_id") == session_id).select(
                F.lit(signal).alias("signal"), "timestamp", "session_id", F.col(label).alias("label")
            )
        )
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.orderBy("timestamp", "signal", "label")
