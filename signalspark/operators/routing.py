"""First-match routing of rows to named sinks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Where rows of a source go; all given conditions must hold, and none given matches nothing."""

    sinks: tuple[str, ...]
    source: str | None = None
    source_type: str | None = None

    def predicate(self) -> Column:
        wanted = {"source": self.source, "source_type": self.source_type}
        tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
        if not tests:
            return F.lit(False)
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result


def route(df: DataFrame, rules: Iterable[Rule], default: Iterable[str] = ()) -> DataFrame:
    """Add ``sinks``: those of the first rule that matches, else the default; rows for no sink are dropped."""

    def names(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    sinks = names(default)
    for rule in reversed(list(rules)):
        sinks = F.when(rule.predicate(), names(rule.sinks)).otherwise(sinks)
    return df.withColumn("sinks", sinks).where(F.size("sinks") > 0)


def for_sink(routed: DataFrame, sink: str) -> DataFrame:
    return routed.where(F.array_contains("sinks", sink)).drop("sinks")
