"""Transformers by name, applied one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from signalspark.operators import jsonfilter, reduce, redact, templates

Transformer = Callable[[DataFrame], DataFrame]
_FACTORIES: dict[str, Callable[[Mapping], Transformer]] = {}


def register(name: str, factory: Callable[[Mapping], Transformer]) -> None:
    """Make a transformer known: ``factory`` turns its options into a DataFrame function."""
    if name in _FACTORIES:
        raise ValueError(f"transformer {name!r} is already registered")
    _FACTORIES[name] = factory


def names() -> list[str]:
    return sorted(_FACTORIES)


def create(name: str, options: Mapping | None = None) -> Transformer:
    if name not in _FACTORIES:
        raise ValueError(f"unknown transformer {name!r}")
    return _FACTORIES[name](options or {})


def noop(df: DataFrame) -> DataFrame:
    return df


def chain(df: DataFrame, steps: Iterable[Mapping]) -> DataFrame:
    """Apply ``{"type": name, "enabled": bool, ...options}`` in order; an error fails the query."""
    for step in steps:
        options = {k: v for k, v in step.items() if k not in ("type", "enabled")}
        transformer = create(step["type"], options)
        if step.get("enabled", True):
            df = df.transform(transformer)
    return df


def _filter(options: Mapping) -> Transformer:
    config = jsonfilter.FilterConfig.of(options)
    return lambda df: jsonfilter.json_filter(df, config, options.get("message", "message"))


def _redact(options: Mapping) -> Transformer:
    settings = {k: v for k, v in options.items() if k != "message"}
    config = redact.RedactConfig(**settings)
    return lambda df: redact.redact(df, config, options.get("message", "message"))


def _reduce(options: Mapping) -> Transformer:
    known = ("group_by", "window_ms", "max_events", "min_events")
    config = reduce.ReduceConfig(**{k: options[k] for k in known if k in options})
    places = {k: options[k] for k in ("message", "ts", "order") if k in options}
    return lambda df: reduce.reduce_messages(df, config, **places)


def _patterns(options: Mapping) -> Transformer:
    return lambda df: templates.cluster(df, **options).assigned


register("noop", lambda options: noop)
register("filter", _filter)
register("redact", _redact)
register("reduce", _reduce)
register("pattern_matcher", _patterns)
