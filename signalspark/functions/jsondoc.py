"""Strict JSON documents on top of VARIANT: kinds, texts and presence by dot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A parser that stops after the first value would accept trailing text, so the message is
# wrapped in an object whose last key must be reached.
_END = "~end"

# What counts as number text: no suffixes, no inner or outer spaces.
NUMBER = r"(?:[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns behind a generator.

    A later filter on them is then not copied below it, where every use would compute them again.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def with_document(df: DataFrame, message: Column, name: str = "_doc") -> DataFrame:
    """Add the message as a VARIANT ``{"doc": ...}``, null when it is not one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit('{"doc":'), message, F.lit(f',"{_END}":1}}')))
    parsed = computed_once(df, wrapped.alias(name))
    whole = F.try_variant_get(F.col(name), f'$["{_END}"]', "int") == 1
    return parsed.withColumn(name, F.when(whole, F.col(name)))


def with_fields(df: DataFrame, message: Column, names: list[str], *extra: Column) -> DataFrame:
    """Add ``_doc``, a struct with the named top-level fields as VARIANT, in one parse.

    ``_complete`` is null when the message is not one JSON value; ``_doc`` when it is not an object.
    ``extra`` columns are computed along with it: parsing and lambdas keep a step from being
    compiled, so they are best kept together in one.
    """
    fields = ", ".join(f"`{name}`: variant" for name in names)
    wrapped = F.concat(F.lit('{"doc":'), message, F.lit(f',"{_END}":1}}'))
    parsed = F.from_json(wrapped, f"struct<doc: struct<{fields}>, `{_END}`: int>")
    made = computed_once(df, parsed.alias("_parsed"), *extra)
    return made.withColumns({"_doc": F.col("_parsed.doc"), "_complete": F.col(f"_parsed.`{_END}`")}).drop("_parsed")


def variant_path(path: str) -> str:
    parts = path.split(".")
    if any('"' in part for part in parts):
        raise ValueError(f"cannot address JSON field {path!r}")
    return '$["doc"]' + "".join(f'["{part}"]' for part in parts)


def value_at(document: Column, path: str | None) -> Column:
    """The value at a dot path; a JSON null is present, a missing field is SQL null."""
    return F.try_variant_get(document, variant_path(path) if path else '$["doc"]', "variant")


def _let(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def number_text(number: Column) -> Column:
    """A double as JSON writers print it: the fewest digits that give it back, whole numbers with
    ``.0``, and an exponent only below 1e-5 and from 1e16 on."""
    zero = F.lit("0")

    def parts(plain: Column) -> Column:
        whole, fraction, exponent = (
            F.regexp_extract(plain, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i) for i in (1, 2, 3)
        )
        return F.struct(
            F.ltrim(whole, zero).alias("whole"),
            F.rtrim(fraction, zero).alias("fraction"),
            F.coalesce(exponent.try_cast("int"), F.lit(0)).alias("exponent"),
        )

    def placed(x: Column) -> Column:
        """The significant digits, and where the point stands in them."""
        digits = F.ltrim(F.concat(x["whole"], x["fraction"]), zero)
        before = F.length(F.ltrim(x["fraction"], zero)) - F.length(x["fraction"])
        point = x["exponent"] + F.when(x["whole"] != "", F.length(x["whole"])).otherwise(before)
        return F.struct(F.rtrim(digits, zero).alias("digits"), point.alias("point"))

    def written(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        size = F.length(digits)
        rest = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
        return (
            F.when(digits == "", F.lit("0.0"))
            .when((point >= size) & (point <= 16), F.concat(F.rpad(digits, point, "0"), F.lit(".0")))
            .when(
                (point > 0) & (point <= 16),
                F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)),
            )
            .when((point > -5) & (point <= 0), F.concat(F.lit("0."), F.repeat(zero, -point), digits))
            .otherwise(
                F.concat(F.substring(digits, F.lit(1), F.lit(1)), rest, F.lit("e"), (point - 1).cast("string"))
            )
        )

    text = _let(_let(_let(F.abs(number).cast("string"), parts), placed), written)
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(""), text)


class Scalar:
    """Tests on one JSON value; every test is false where the value is missing."""

    def __init__(self, value: Column):
        self.value = value
        self.kind = F.schema_of_variant(value)
        # Integers up to 64 bits print as they are, all other numbers as doubles.
        plain, self.double = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        wide = (self.double >= 2.0**63) & (self.double < 2.0**64) & plain.rlike(r"^[0-9]+$")
        self.is_real = F.coalesce(self.kind.startswith("DECIMAL") | self.kind.isin("DOUBLE", "FLOAT"), F.lit(False))
        self.text = F.when(self.is_real & ~wide, number_text(self.double)).otherwise(plain)
        self._plain = plain
        self.present = value.isNotNull()
        self.is_null = F.coalesce(self.kind == "VOID", F.lit(False))
        self.is_string = F.coalesce(self.kind == "STRING", F.lit(False))
        self.is_object = F.coalesce(self.kind.startswith("OBJECT"), F.lit(False))
        nested = self.kind.startswith("OBJECT") | self.kind.startswith("ARRAY")
        self.is_scalar = F.coalesce(~nested & (self.kind != "VOID"), F.lit(False))

    def equals(self, expected: str) -> Column:
        if expected == "null":
            same = self.is_null | (self.is_scalar & (self.text == "null"))
        else:
            same = self.is_scalar & (self.text == expected)
        return F.coalesce(same, F.lit(False))

    def number(self) -> Column:
        """The value as a double if it is a number or number text."""
        guarded = F.when(self._plain.rlike(rf"^{NUMBER}\z"), self._plain.try_cast("double"))
        parsed = F.when(self.is_scalar & (self.kind != "BOOLEAN"), F.when(self.is_string, guarded).otherwise(self.double))
        return F.when(~F.isnan(parsed), parsed)


def json_depth(col: Column) -> Column:
    """Deepest nesting of braces and brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(col, r"(?s)\\.", ""), r'"[^"]*"?', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc, char):
        depth = F.when(char.isin("{", "["), acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest"))

    walked = F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["deepest"])
    return F.when(F.length(brackets) == 0, F.lit(0)).otherwise(walked)


def too_deep(col: Column, limit: int) -> Column:
    """Deeper than ``limit``; texts with no more openers than that need no closer look."""
    many = col.rlike(rf"^(?:[^\[{{]*+[\[{{]){{{limit + 1}}}")
    return F.when(~many, F.lit(False)).otherwise(json_depth(col) > limit)


def with_object(df: DataFrame, name: str, sources: dict[str, Column]) -> DataFrame:
    """Add the JSON text of several ``map<string,variant>`` merged with sorted keys; later maps win.

    The maps become columns first: inside the lambda they would be built anew for every key.
    """
    columns = [f"_source_{key}" for key in sources]
    made = computed_once(df, *[source.alias(column) for source, column in zip(sources.values(), columns)])
    empty = F.array().cast("array<string>")
    keys = F.sort_array(F.array_distinct(F.concat(*[F.coalesce(F.map_keys(c), empty) for c in columns])))
    entries = F.transform(
        keys, lambda key: F.struct(key, F.coalesce(*[F.try_element_at(c, key) for c in reversed(columns)]))
    )
    return made.withColumn(name, F.to_json(F.map_from_entries(entries))).drop(*columns)


def object_at(document: Column, path: str) -> Column:
    """The object at a path as ``map<string,variant>``, or null when it is missing or something else."""
    return F.try_variant_get(document, variant_path(path), "map<string,variant>")


def single_entry(key: str, value: Column) -> Column:
    """``{key: value}`` as ``map<string,variant>``, or null where the value is missing."""
    return F.when(value.isNotNull(), F.create_map(F.lit(key), value.cast("variant")))
