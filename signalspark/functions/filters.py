"""Query-side conditions: field, operator and text value to one Column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalspark.functions.ranges import Range, parse_range

DEFAULT_RANGE = "30d"
DEFAULT_TOP = 10
DEFAULT_DRILL = 100

# Accepted spellings of each operator.
OPERATORS = {
    "eq": ["eq", "=", "=="],
    "ne": ["ne", "!=", "<>"],
    "gt": ["gt", ">"],
    "gte": ["gte", ">="],
    "lt": ["lt", "<"],
    "lte": ["lte", "<="],
    "contains": ["contains", "like"],
    "not_contains": ["not_contains", "not_like"],
    "starts_with": ["starts_with"],
    "ends_with": ["ends_with"],
    "in": ["in"],
    "not_in": ["not_in"],
    "is_set": ["is_set", "isset"],
    "is_not_set": ["is_not_set", "isnotset"],
    "regex": ["regex", "~"],
}

# Accepted spellings of each comparison mode.
COMPARE_MODES = {
    "previous": ["previous", "prev", "previous_period"],
    "previous_year": ["previous_year", "yoy", "year_over_year"],
}


def _canonical(table: dict[str, list[str]], text: str, what: str) -> str:
    for name, spellings in table.items():
        if text.lower() in spellings:
            return name
    raise ValueError(f"unknown {what} {text!r}")


def parse_operator(text: str) -> str:
    return _canonical(OPERATORS, text, "operator")


def parse_compare(text: str) -> str:
    return _canonical(COMPARE_MODES, text, "compare mode")


def json_path(path: str) -> str:
    """``a.b`` as a JSON path whose parts are taken literally."""
    parts = path.split(".")
    if any(not part or "'" in part or part == "*" for part in parts):
        raise ValueError(f"cannot address JSON field {path!r}")
    return "$" + "".join(f"['{part}']" for part in parts)


def field_column(df: DataFrame, name: str) -> Column:
    """A plain column, or for ``column.a.b`` the text at that path of a JSON column."""
    if name in df.columns:
        return df[f"`{name}`"]
    base, dot, path = name.partition(".")
    if not dot or base not in df.columns:
        raise ValueError(f"no field {name!r}")
    return F.get_json_object(df[f"`{base}`"], json_path(path))


def _literal(df: DataFrame, name: str, value: str) -> Column:
    kind = df.schema[name].dataType if name in df.columns else T.StringType()
    return F.lit(value) if isinstance(kind, T.StringType) else F.lit(value).cast(kind)


@dataclass(frozen=True)
class Condition:
    """One test; ``value`` is a string, a list of strings for in / not_in, or None for is_set."""

    field: str
    operator: str = "eq"
    value: str | tuple[str, ...] | list[str] | None = None

    def to_column(self, df: DataFrame) -> Column:
        name = parse_operator(self.operator)
        if self.field == "source_ip":
            return ip_condition(name, self.value)
        column = field_column(df, self.field)
        if name in ("is_set", "is_not_set"):
            return column.isNotNull() if name == "is_set" else column.isNull()
        if name in ("in", "not_in"):
            values = _many(name, self.value)
            found = column.isin([_literal(df, self.field, value) for value in values])
            return found if name == "in" else ~found
        text = _single(name, self.value)
        if name in _COMPARISONS:
            return _COMPARISONS[name](column, _literal(df, self.field, text))
        return _TEXT_TESTS[name](column.cast("string"), text)


_COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}

_TEXT_TESTS = {
    "contains": lambda c, v: c.contains(v),
    "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "regex": lambda c, v: c.rlike("(?U)" + v),
}


def _single(operator: str, value) -> str:
    if not isinstance(value, str):
        raise ValueError(f"operator {operator} needs one value")
    return value


def _many(operator: str, value) -> list[str]:
    if isinstance(value, str) or value is None:
        raise ValueError(f"operator {operator} needs a list of values")
    return list(value)


def _address(value: str) -> str:
    """An address in the form in which tables store it, as ``norm_ip`` makes it."""
    text = value.strip(" ")
    return f"::ffff:{text}" if "." in text and ":" not in text else text


def ip_condition(operator: str, value) -> Column:
    """Address tests on ``source_ip``, which holds addresses in stored form; the value may have any form."""
    column = F.col("source_ip")
    if operator in ("is_set", "is_not_set"):
        return column.isNotNull() if operator == "is_set" else column.isNull()
    if operator in ("eq", "ne"):
        wanted = F.lit(_address(_single(operator, value)))
        return column == wanted if operator == "eq" else column != wanted
    if operator in ("in", "not_in"):
        found = column.isin([F.lit(_address(v)) for v in _many(operator, value)])
        return found if operator == "in" else ~found
    raise ValueError(f"operator {operator} does not apply to addresses")


def parse_conditions(params: Mapping[str, str | list[str]]) -> list[Condition]:
    """Conditions from flattened keys such as ``conditions[0][field]`` and ``conditions[0][value][]``."""
    gathered: dict[int, dict] = {}
    for key, value in params.items():
        found = re.fullmatch(r"conditions\[(\d+)\]\[([^\]]+)\](\[\])?", key)
        if not found:
            continue
        slot = gathered.setdefault(int(found[1]), {})
        if found[3]:
            slot.setdefault("many", []).extend([value] if isinstance(value, str) else value)
        else:
            slot[found[2]] = value
    result = []
    for index in sorted(gathered):
        slot = gathered[index]
        if not slot.get("field"):
            continue
        operator = parse_operator(slot.get("operator", "eq"))
        value = slot.get("many", slot.get("value"))
        if value is None and operator not in ("is_set", "is_not_set"):
            continue
        result.append(Condition(slot["field"], operator, value))
    return result


@dataclass(frozen=True)
class Filter:
    """What to look at: a period, a bucket width, conditions, and optionally a breakdown, comparison, limit."""

    time_range: Range = field(default_factory=lambda: parse_range(DEFAULT_RANGE))
    granularity: str | None = "daily"
    conditions: tuple[Condition, ...] = ()
    breakdown: str | None = None
    compare: str | None = None
    limit: int | None = None

    @classmethod
    def over(cls, text: str, now: datetime | None = None, **options) -> Filter:
        return cls(parse_range(text, now), **options)

    def with_conditions(self, extra: Iterable[Condition]) -> Filter:
        return replace(self, conditions=(*self.conditions, *extra))

    def with_limit(self, limit: int) -> Filter:
        return replace(self, limit=limit)

    def where(self, event=None, service=None, level=None, source=None) -> Filter:
        """Shortcuts for the common equality tests."""
        wanted = {"event_name": event, "service": service, "level": level, "source": source}
        return self.with_conditions(Condition(k, "eq", v) for k, v in wanted.items() if v is not None)

    def comparison(self) -> Filter:
        """The same question over the comparison period; the limit does not carry over."""
        mode = parse_compare(self.compare or "previous")
        period = self.time_range.previous_period() if mode == "previous" else self.time_range.previous_year()
        return replace(self, time_range=period, compare=None, limit=None)

    def apply(self, df: DataFrame, ts: str = "timestamp") -> DataFrame:
        """Rows inside the period that meet every condition."""
        kept = df.where(self.time_range.predicate(df, ts))
        for condition in self.conditions:
            kept = kept.where(condition.to_column(df))
        return kept

    def capped(self, df: DataFrame) -> DataFrame:
        return df if self.limit is None else df.limit(self.limit)
