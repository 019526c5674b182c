"""Keep or drop JSON messages by conditions on their fields."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signalspark.functions.jsondoc import NUMBER, Scalar, computed_once, value_at, with_document

OPERATORS = ("eq", "ne", "contains", "starts_with", "ends_with", "exists", "gt", "lt", "gte", "lte", "regex")


@dataclass(frozen=True)
class Cond:
    """A test on the value at a dot path."""

    field: str
    operator: str = "eq"
    value: str | None = None

    def __post_init__(self):
        if not self.field:
            raise ValueError("a condition needs a field")
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.operator != "exists" and self.value is None:
            raise ValueError(f"operator {self.operator} needs a value")

    def test(self, found: Scalar) -> Column:
        """True or false, never null; only ``ne`` holds for a missing field."""
        if self.operator == "exists":
            return found.present
        if self.operator == "eq":
            return found.equals(self.value)
        if self.operator == "ne":
            return ~found.equals(self.value)
        if self.operator in ("gt", "lt", "gte", "lte"):
            return F.coalesce(self._ordered(found.number()), F.lit(False))
        text = F.when(found.is_scalar, found.text)
        result = {
            "contains": lambda: F.contains(text, F.lit(self.value)),
            "starts_with": lambda: F.startswith(text, F.lit(self.value)),
            "ends_with": lambda: F.endswith(text, F.lit(self.value)),
            "regex": lambda: text.rlike("(?U)" + self.value),
        }[self.operator]()
        return F.coalesce(result, F.lit(False))

    def _ordered(self, number: Column) -> Column:
        wanted = F.when(F.lit(self.value).rlike(rf"^{NUMBER}\z"), F.lit(self.value).try_cast("double"))
        wanted = F.when(~F.isnan(wanted), wanted)
        return {
            "gt": number > wanted,
            "lt": number < wanted,
            "gte": number >= wanted,
            "lte": number <= wanted,
        }[self.operator]


@dataclass(frozen=True)
class FilterConfig:
    action: str = "drop"
    match: str = "all"
    conditions: tuple[Cond, ...] = ()

    def __post_init__(self):
        if self.action not in ("drop", "keep"):
            raise ValueError(f"unknown action {self.action!r}")
        if self.match not in ("all", "any"):
            raise ValueError(f"unknown match mode {self.match!r}")
        if not self.conditions:
            raise ValueError("at least one condition is required")

    @classmethod
    def of(cls, options: Mapping) -> FilterConfig:
        """From plain options; one condition may be given inline as field / operator / value."""
        conditions = []
        if "field" in options:
            conditions.append(Cond(options["field"], options.get("operator", "eq"), options.get("value")))
        for entry in options.get("conditions", []):
            if "field" not in entry:
                raise ValueError("a condition needs a field")
            conditions.append(Cond(entry["field"], entry.get("operator", "eq"), entry.get("value")))
        match = options.get("match", options.get("match_mode", "all"))
        return cls(options.get("action", "drop"), match, tuple(conditions))


def json_filter(
    df: DataFrame, config: FilterConfig, message: str = "message", observe: Observation | None = None
) -> DataFrame:
    """Drop or keep the messages that match; a message that is not JSON matches nothing.

    With ``observe``, the counts received / passed / dropped and the drop rate are collected as
    the rows pass by.
    """
    parsed = with_document(df, F.col(message))
    paths = list(dict.fromkeys(cond.field for cond in config.conditions))
    names = {path: f"_value_{i}" for i, path in enumerate(paths)}
    values = computed_once(parsed, *[value_at(F.col("_doc"), path).alias(names[path]) for path in paths])
    tests = [cond.test(Scalar(F.col(names[cond.field]))) for cond in config.conditions]
    joined = reduce((lambda a, b: a & b) if config.match == "all" else (lambda a, b: a | b), tests)
    matched = F.coalesce(F.col("_doc").isNotNull() & joined, F.lit(False))
    passes = ~matched if config.action == "drop" else matched
    if observe is None:
        return values.where(passes).select(*df.columns)
    marked = values.select(*df.columns, passes.alias("_passes"))
    passed = F.count_if("_passes")
    received = F.count(F.lit(1))
    marked = marked.observe(
        observe,
        received.alias("received"),
        passed.alias("passed"),
        (received - passed).alias("dropped"),
        F.coalesce((received - passed) / received, F.lit(0.0)).alias("drop_rate"),
    )
    return marked.where("_passes").drop("_passes")
