"""Read-only SQL within one workspace, and the catalogue of what can be asked about."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.schema import TABLES
from signalspark.sources import lake

DEFAULT_LIMIT = 1000
DEFAULT_VALUES = 1000
MAX_SEARCH = 100

# Words that never belong in a read-only query.
BANNED = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE"]

# Data sources by name, with their table, and the fields that can be asked for.
SOURCES = {
    "events": "events_v1",
    "logs": "logs_v1",
    "context": "context_v1",
    "user_traits": "user_traits",
    "users": "users_v1",
    "user_devices": "user_devices",
}
FIELDS = {
    "events": {
        "timestamp": "DateTime",
        "event_name": "String",
        "device_id": "String",
        "session_id": "String",
        "properties": "JSON",
    },
    "logs": {"timestamp": "DateTime", "level": "String", "message": "String", "source": "String"},
    "context": {
        "timestamp": "DateTime",
        "device_id": "String",
        "session_id": "String",
        "device_type": "String",
        "operating_system": "String",
        "country": "String",
    },
    "user_traits": {
        "user_id": "String",
        "trait_key": "String",
        "trait_value": "String",
        "updated_at": "DateTime",
    },
    "users": {"user_id": "String", "email": "String", "name": "String", "updated_at": "DateTime"},
    "user_devices": {"user_id": "String", "device_id": "String", "linked_at": "DateTime"},
}

# Quoted texts and comments, in which nothing counts.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""


def _bare(text: str) -> str:
    return re.sub(_QUOTED, "''", text, flags=re.S).strip()


def _check(text: str, starts: tuple[str, ...]) -> None:
    bare = _bare(text)
    if not re.match(rf"(?:{'|'.join(starts)})\b", bare, re.I):
        raise ValueError(f"a query begins with {' or '.join(starts)}")
    if ";" in bare.rstrip().removesuffix(";"):
        raise ValueError("send one statement at a time")
    found = re.search(rf"\b({'|'.join([*BANNED, 'INTO'])})\b", bare, re.I)
    if found:
        raise ValueError(f"{found[1].upper()} has no place in a query that only reads")


def validate_sql(text: str) -> None:
    """One SELECT or WITH statement that only reads; a trailing semicolon is fine."""
    _check(text, ("SELECT", "WITH"))


def validate_sql_strict(text: str) -> None:
    """The same for SELECT statements only."""
    _check(text, ("SELECT",))


def has_limit(text: str) -> bool:
    """Whether the statement as a whole ends in a LIMIT; limits of subqueries do not count."""
    last = _bare(text).rstrip().removesuffix(";").rstrip()
    return re.search(r"\bLIMIT\s+[^()]*$", last, re.I) is not None


def normalise_table_names(text: str, workspace: int) -> str:
    """``<workspace>.<table>`` becomes ``<table>`` for known tables; another workspace's is an error."""
    known = "|".join([*TABLES, *lake.ALIASES])

    def plain(found: re.Match) -> str:
        if found["table"] is None:
            return found[0]
        if int(found["workspace"]) != workspace:
            raise ValueError(f"table {found[0]} belongs to another workspace")
        return found["table"]

    return re.sub(rf"{_QUOTED}|\b(?P<workspace>\d+)\.(?P<table>{known})\b", plain, text, flags=re.S)


Opener = Callable[[SparkSession], DataFrame]


class Workspace:
    """A session of its own whose only tables are one workspace's rows."""

    def __init__(self, spark: SparkSession, workspace: int, tables: Mapping[str, Opener] | None = None):
        self.id = workspace
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        # Tables are reached by name only, never by file path.
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        if tables:
            workspace_views(self.session, workspace, tables)

    @classmethod
    def of_lake(cls, spark: SparkSession, base: str, workspace: int) -> Workspace:
        made = cls(spark, workspace)
        lake.register_tables(made.session, base, workspace)
        return made

    def run_sql(self, text: str, limit: int | None = None, strict: bool = False) -> DataFrame:
        """All rows of the query.

        limit: how many rows at most if the text sets no limit of its own; one in the text stands.
        """
        (validate_sql_strict if strict else validate_sql)(text)
        plain = normalise_table_names(text, self.id).strip().removesuffix(";")
        found = self.session.sql(plain)
        return found if limit is None or has_limit(text) else found.limit(limit)

    def field_values(self, source: str, field: str, search: str | None = None, n: int = DEFAULT_VALUES) -> DataFrame:
        """Distinct values of a catalogued field, optionally those that hold a text."""
        if source not in SOURCES:
            raise ValueError(f"unknown source {source!r}")
        if field not in FIELDS[source]:
            raise ValueError(f"unknown field {field!r} for {source}")
        return field_values(self.session.table(SOURCES[source]), field, search, n)


def workspace_views(session: SparkSession, workspace: int, tables: Mapping[str, Opener]) -> list[str]:
    """Temp views with the workspace's filter built in."""
    for name, opener in tables.items():
        opener(session).where(F.col("workspace_id") == workspace).createOrReplaceTempView(name)
    return sorted(tables)


def field_values(df: DataFrame, field: str, search: str | None = None, n: int = DEFAULT_VALUES) -> DataFrame:
    value = F.col(field).cast("string")
    if search:
        if len(search) > MAX_SEARCH:
            raise ValueError(f"search term is longer than {MAX_SEARCH} characters")
        if not all(c.isalnum() or c in " -_." for c in search):
            raise ValueError("search term holds characters that are not allowed")
        df = df.where(F.contains(value, F.lit(search)))
    return df.select(value.alias(field)).where(F.col(field).isNotNull()).distinct().orderBy(field).limit(n)


def list_sources() -> dict[str, str]:
    return dict(SOURCES)


def list_fields(source: str) -> dict[str, str]:
    if source not in FIELDS:
        raise ValueError(f"unknown source {source!r}")
    return dict(FIELDS[source])


def _cell(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NULL"))


def render(df: DataFrame, fmt: str = "table") -> DataFrame:
    """A result as lines of text in one column ``text``, row by row in the result's order.

    json: one object per row; csv: one record per row; table: cells of equal width. Every row and
    every cell comes whole. ``heading`` gives the line above the rows.
    """
    if fmt == "json":
        return df.select(F.to_json(F.struct("*")).alias("text"))
    if fmt == "csv":
        return df.select(F.to_csv(F.struct("*")).alias("text"))
    if fmt != "table":
        raise ValueError(f"unknown format {fmt!r}")
    widths = _widths(df)
    cells = [F.rpad(_cell(df, name), widths[name], " ") for name in df.columns]
    return df.select(F.concat_ws(" | ", *cells).alias("text"))


def _widths(df: DataFrame) -> dict[str, int]:
    """The width of each column in characters, names included; one row comes to the driver."""
    found = df.agg(*(F.max(F.length(_cell(df, name))) for name in df.columns)).first()
    return {name: max(len(name), most or 0) for name, most in zip(df.columns, found)}


def heading(df: DataFrame, fmt: str = "table") -> str:
    """Column names as the first line of a table or of CSV; nothing for JSON."""
    if fmt == "json":
        return ""
    if fmt == "csv":
        return ",".join(df.columns)
    return " | ".join(name.ljust(width) for name, width in _widths(df).items())


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result as files: JSON lines, CSV with a heading in every file, or table lines."""
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    else:
        render(df, fmt).write.text(path)
