"""Column expressions that bring ingested values to their stored form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalspark.schema import DEFAULT_SEVERITY, EVENT_TYPES, NIL_UUID, SEVERITY

# Ingest spellings of each log level; anything else is info.
LEVEL_ALIASES = {
    "trace": ["trace"],
    "debug": ["debug"],
    "fatal": ["fatal", "critical", "crit", "emergency", "emerg", "alert"],
    "error": ["error", "err"],
    "warning": ["warning", "warn", "notice"],
    "info": ["info", "information"],
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_HEXTET = r"[0-9a-fA-F]{1,4}"


def _ipv6_pattern() -> str:
    """Full form, or one ``::`` that stands for at least one group; the last two groups may be IPv4."""
    forms = [rf"(?:{_HEXTET}:){{7}}{_HEXTET}", rf"(?:{_HEXTET}:){{6}}{_IPV4}"]
    for left in range(8):
        head = "" if left == 0 else rf"{_HEXTET}(?::{_HEXTET}){{{left - 1}}}"
        room = 7 - left
        tails = [""]
        if room:
            tails.append(rf"{_HEXTET}(?::{_HEXTET}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(rf"(?:{_HEXTET}:){{0,{room - 2}}}{_IPV4}")
        forms.append(rf"{head}::(?:{'|'.join(tails)})")
    return "|".join(forms)


IP_ADDRESS = rf"^(?:{_IPV4}|{_ipv6_pattern()})\z"


def norm_uuid(col: Column) -> Column:
    """Lower-case hyphenated form of 32 hex digits, however hyphenated; null when it is not one."""
    digits = F.lower(F.replace(col, F.lit("-"), F.lit("")))
    dashed = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return F.when(digits.rlike(r"^[0-9a-f]{32}\z"), dashed)


def nil_uuid(col: Column) -> Column:
    return F.coalesce(col, F.lit(NIL_UUID))


def ts_from_ms(col: Column, now_ms: int | Column | None = None) -> Column:
    """Epoch milliseconds to a timestamp; ``now_ms`` (the query's own time if not given) where missing."""
    if now_ms is None:
        return F.coalesce(F.timestamp_millis(col), F.current_timestamp())
    fallback = now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("bigint")
    return F.timestamp_millis(F.coalesce(col, fallback))


def norm_event_type(col: Column) -> Column:
    lowered = F.lower(col)
    return F.when(lowered.isin(EVENT_TYPES), lowered).otherwise(F.lit("unknown"))


def norm_log_level(col: Column) -> Column:
    """Level name with its aliases folded in; unknown or missing levels become info."""
    result = F.lit("info")
    for name, aliases in LEVEL_ALIASES.items():
        result = F.when(F.lower(col).isin(aliases), F.lit(name)).otherwise(result)
    return result


def severity(col: Column) -> Column:
    """Storage rank of a level name, 0 (emergency) to 8 (trace)."""
    result = F.lit(DEFAULT_SEVERITY)
    for rank in sorted(set(SEVERITY.values())):
        names = [name for name, value in SEVERITY.items() if value == rank]
        result = F.when(F.upper(col).isin(names), F.lit(rank)).otherwise(result)
    return result


def norm_ip(col: Column) -> Column:
    """Address text in IPv6 form: a dotted IPv4 address becomes ``::ffff:a.b.c.d``."""
    trimmed = F.trim(col)
    dotted = F.contains(trimmed, F.lit(".")) & ~F.contains(trimmed, F.lit(":"))
    return F.when(dotted, F.concat(F.lit("::ffff:"), trimmed)).otherwise(trimmed)


def client_ip(forwarded: Column, xff: Column, connection: Column, forwarding: bool = False) -> Column:
    """The address a message came from.

    In forwarding mode a trusted upstream names it; otherwise the first X-Forwarded-For
    entry counts if it is an address, and the connection's own address is the last resort.
    """
    if forwarding:
        return F.coalesce(F.when(forwarded.rlike(IP_ADDRESS), forwarded), connection)
    first = F.trim(F.split(xff, ",")[0])
    return F.coalesce(F.when(first.rlike(IP_ADDRESS), first), connection)


def norm_locale(col: Column) -> Column:
    """Exactly five characters: cut, or padded with spaces."""
    return F.rpad(col, 5, " ")


def user_id_from_email(col: Column) -> Column:
    """UUID v5 (DNS namespace) of the trimmed lower-case address; empty when there is none."""
    address = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    namespace = F.unhex(F.lit(uuid.NAMESPACE_DNS.hex))
    digest = F.sha1(F.concat(namespace, F.encode(address, "UTF-8")))
    variant = F.substring(
        F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1)
    )
    text = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.when(F.length(address) > 0, text).otherwise(F.lit(""))


def json_str(col: Column, key: str) -> Column:
    """Text of one top-level JSON field, or null."""
    return F.get_json_object(col, f"$['{key}']")


def json_map(col: Column, key: str) -> Column:
    """An object-valued JSON field as a map from key to value text, or null."""
    return F.from_json(F.get_json_object(col, f"$['{key}']"), "map<string,string>")
