"""Finding personal data in texts and JSON messages, and masking or pseudonymising it."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in patterns and the prefix of each one's pseudonyms.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": (
        r"(?:\+?[1-9]\d{0,2}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}(?:[-.\s]?\d{1,4})?"
    ),
    "credit_card": r"\b(?:\d[ -]*?){13,19}\b",
    "ssn_us": r"\b\d{3}-\d{2}-\d{4}\b",
    "cpr_dk": r"\b\d{6}-\d{4}\b",
    "nino_uk": r"\b[A-Z]{2}\d{6}[A-Z]\b",
    "bsn_nl": r"\b\d{9}\b",
    "ipv4": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
    ),
    "ipv6": (
        r"(?i)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,7}:"
        r"|(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}"
        r"|(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}|(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}"
        r"|(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}|[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}"
        r"|:(?::[0-9a-f]{1,4}){1,7}|::)"
    ),
    "passport": r"\b[A-Z0-9]{6,9}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",
}
PREFIXES = {
    "email": "usr_",
    "phone": "phn_",
    "credit_card": "cc_",
    "ssn_us": "ssn_",
    "cpr_dk": "cpr_",
    "nino_uk": "nin_",
    "bsn_nl": "bsn_",
    "ipv4": "ip4_",
    "ipv6": "ip6_",
    "passport": "pas_",
    "iban": "iba_",
}
MASK = "[REDACTED]"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HASHED_BYTES = 12


@dataclass(frozen=True)
class CustomPattern:
    name: str
    regex: str
    prefix: str

    def __post_init__(self):
        if not self.prefix:
            raise ValueError(f"custom pattern {self.name!r} needs a prefix")
        re.compile(self.regex)


@dataclass(frozen=True)
class Target:
    """One field to redact: a dot path, the name of the pattern it must match, and its own strategy."""

    path: str
    pattern: str
    strategy: str | None = None


@dataclass(frozen=True)
class RedactConfig:
    strategy: str = "redact"
    hash_key: str | None = None
    patterns: tuple[str, ...] = ()
    fields: tuple[Target, ...] = ()
    custom: tuple[CustomPattern, ...] = ()
    scan_all: bool = False

    def __post_init__(self):
        strategies = {self.strategy, *(f.strategy for f in self.fields if f.strategy)}
        if strategies - {"redact", "hash"}:
            raise ValueError(f"unknown strategy in {sorted(strategies)}")
        if "hash" in strategies and self.hash_key is None:
            raise ValueError("the hash strategy needs a hash_key")
        if not (self.patterns or self.fields or self.custom):
            raise ValueError("at least one pattern, field or custom pattern is required")
        for name in self.patterns:
            if name not in PATTERNS:
                raise ValueError(f"unknown pattern {name!r}")

    def scanned(self) -> list[tuple[str, str]]:
        """(regex, prefix) of the patterns that a scan looks for, in order."""
        built_in = [(PATTERNS[name], PREFIXES[name]) for name in self.patterns]
        return built_in + [(c.regex, c.prefix) for c in self.custom]

    def named(self, name: str) -> list[tuple[str, str]]:
        """(regex, prefix) of a pattern name; a custom pattern may share a built-in name."""
        found = [(PATTERNS[name], PREFIXES[name])] if name in PATTERNS else []
        return found + [(c.regex, c.prefix) for c in self.custom if c.name == name]


# The email pattern begins with an open-ended run of characters, which a backtracking matcher tries
# again from every place inside a long run. This form finds the same matches, but takes each run
# from its start, or from where the last match ended, and once only.
_RUN_ONLY = r"(?<![a-zA-Z0-9._%+-])"
_RUN_START = rf"(?:\G|{_RUN_ONLY})"
_ONE_TRY_PER_RUN = {
    PATTERNS["email"]: _RUN_START + r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
}


def java_regex(pattern: str) -> str:
    """With character classes and word boundaries over all of Unicode."""
    return "(?U)" + _ONE_TRY_PER_RUN.get(pattern, pattern)


# --- pseudonyms, all in column expressions


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA256 as lower-case hex."""
    raw = key.encode()
    block = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def _base62(digest: Column) -> Column:
    """The first 12 bytes of a hex digest as one little-endian number in base 62, without leading zeros."""
    big = "decimal(38,0)"
    reversed_hex = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(HASHED_BYTES))])
    words = [F.conv(F.substring(reversed_hex, 8 * i + 1, 8), 16, 10).cast(big) for i in range(3)]
    high, middle = (F.lit(str(2**power)).cast(big) for power in (64, 32))
    number = (words[0] * high + words[1] * middle + words[2]).cast(big)
    # 17 digits hold 96 bits; three steps of six digits keep each piece within a bigint.
    step = 62**6

    def split(pieces: Column, _: Column) -> Column:
        left = pieces["left"]
        piece = (left % F.lit(step).cast(big)).cast("bigint")
        rest = ((left - piece.cast(big)) / F.lit(step).cast(big)).cast(big)
        return F.struct(rest.alias("left"), F.concat(F.array(piece), pieces["done"]).alias("done"))

    start = F.struct(number.alias("left"), F.array().cast("array<bigint>").alias("done"))
    pieces = F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), start, split, lambda acc: acc["done"])

    def spell(piece: Column) -> Column:
        digits = [
            F.substring(F.lit(ALPHABET), (F.floor(piece / F.lit(62**power)) % 62 + 1).cast("int"), F.lit(1))
            for power in reversed(range(6))
        ]
        return F.concat(*digits)

    text = F.array_join(F.transform(pieces, spell), "")
    return F.regexp_replace(text, r"^0+(?=.)", "")


def pseudonym(value: Column, key: str, prefix: str = "pii_") -> Column:
    """Prefix and keyed hash: the same value and key always give the same pseudonym."""
    return F.concat(F.lit(prefix), _base62(hmac_sha256(value, key)))


# --- plain texts, all in column expressions


def redact_text(col: Column, config: RedactConfig) -> Column:
    """Replace what the scanned patterns find in a text.

    Matches are looked up in the original text, pattern by pattern; each found string is then
    replaced wherever it occurs in the text as it stands by then.
    """
    result = col
    for regex, prefix in config.scanned():
        found = F.regexp_extract_all(col, F.lit(java_regex(regex)), F.lit(0))
        result = F.aggregate(found, result, _replacing(config, prefix))
    return result


def _replacing(config: RedactConfig, prefix: str):
    def replace(text: Column, match: Column) -> Column:
        new = F.lit(MASK) if config.strategy == "redact" else pseudonym(match, config.hash_key, prefix)
        return F.replace(text, match, new)

    return replace


def redact_column(df: DataFrame, column: str, pattern: str, config: RedactConfig) -> DataFrame:
    """A flat column: the whole value is replaced where the pattern matches anywhere in it."""
    value, result = F.col(column), F.col(column)
    for regex, prefix in reversed(config.named(pattern)):
        new = F.lit(MASK) if config.strategy == "redact" else pseudonym(value, config.hash_key, prefix)
        result = F.when(value.rlike(java_regex(regex)), new).otherwise(result)
    return df.withColumn(column, result)


def pii_report(df: DataFrame, column: str, patterns: list[str] | None = None) -> DataFrame:
    """How often each pattern occurs in a column, and in how many rows, in one pass."""
    names = patterns or list(PATTERNS)
    counted = df.select(
        *[F.coalesce(F.regexp_count(column, F.lit(java_regex(PATTERNS[n]))), F.lit(0)).alias(n) for n in names]
    )
    totals = counted.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        *[F.count_if(F.col(n) > 0).alias(f"{n}_rows") for n in names],
    )
    rows = [
        F.struct(F.lit(n).alias("pattern"), F.col(n).alias("matches"), F.col(f"{n}_rows").alias("rows")) for n in names
    ]
    return totals.select(F.inline(F.array(*rows)))


# --- JSON messages: nested rewriting has no column expression, so batches of texts go to Python


def _hash(value: str, key: str, prefix: str) -> str:
    digest = hmac.new(key.encode(), value.encode(errors="surrogatepass"), hashlib.sha256).digest()
    number, digits = int.from_bytes(digest[:HASHED_BYTES], "little"), ""
    while number:
        number, rest = divmod(number, 62)
        digits = ALPHABET[rest] + digits
    return prefix + (digits or "0")


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    number = float(text)
    if math.isinf(number):
        raise ValueError(f"{text} is out of range")
    return number


class _Finder:
    """Non-empty matches of a pattern in order; a run that cannot begin a match is tried once, not from every place."""

    def __init__(self, regex: str):
        once = _ONE_TRY_PER_RUN.get(regex)
        # Where a match may begin: anywhere, or at the start of a run or where the last match ended.
        self.anywhere = re.compile(regex if once is None else once.replace(_RUN_START, _RUN_ONLY))
        self.here = None if once is None else re.compile(once.replace(_RUN_START, ""))

    def __call__(self, text: str) -> Iterator[str]:
        if self.here is None:
            yield from (m[0] for m in self.anywhere.finditer(text) if m[0])
            return
        at = 0
        while found := self.here.match(text, at) or self.anywhere.search(text, at):
            yield found[0]
            at = found.end()


class _JsonRedactor:
    """Rewrites one message at a time inside a task."""

    def __init__(self, config: RedactConfig):
        self.config = config
        self.scanned = [(_Finder(regex), prefix) for regex, prefix in config.scanned()]
        self.targets = [
            (t.path.split("."), [(_Finder(r), p) for r, p in config.named(t.pattern)], t.strategy or config.strategy)
            for t in config.fields
        ]

    def replacement(self, value: str, prefix: str, strategy: str) -> str:
        return MASK if strategy == "redact" else _hash(value, self.config.hash_key, prefix)

    def text(self, value: str) -> str:
        result = value
        for finder, prefix in self.scanned:
            for match in finder(value):
                result = result.replace(match, self.replacement(match, prefix, self.config.strategy))
        return result

    def scan(self, value):
        if isinstance(value, str):
            return self.text(value)
        if isinstance(value, list):
            return [self.scan(item) for item in value]
        if isinstance(value, dict):
            return {key: self.scan(item) for key, item in value.items()}
        return value

    def target(self, document, path, regexes, strategy) -> None:
        for part in path[:-1]:
            document = document.get(part) if isinstance(document, dict) else None
        value = document.get(path[-1]) if isinstance(document, dict) else None
        if isinstance(value, str):
            for finder, prefix in regexes:
                if next(finder(value), None) is not None:
                    document[path[-1]] = self.replacement(value, prefix, strategy)
                    return

    def message(self, text: str | None) -> str | None:
        if text is None:
            return None
        try:
            document = json.loads(text, parse_constant=_refuse, parse_float=_finite)
            for target in self.targets:
                self.target(document, *target)
            if self.config.scan_all:
                document = self.scan(document)
        except (ValueError, RecursionError):  # no JSON, a number out of range, or nested too deeply
            return self.text(text) if self.config.scan_all else text
        plain = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        try:
            plain.encode()
        except UnicodeEncodeError:  # half of a surrogate pair, which only an escape can spell
            return json.dumps(document, sort_keys=True, separators=(",", ":"))
        return plain


def redact(df: DataFrame, config: RedactConfig, message: str = "message") -> DataFrame:
    """Redact JSON messages: the targeted fields, then with ``scan_all`` every string at any depth.

    JSON comes out with sorted keys. Texts that are not JSON are scanned as text with
    ``scan_all`` and otherwise left alone.
    """

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        redactor = _JsonRedactor(config)
        for texts in batches:
            yield texts.map(redactor.message)

    return df.withColumn(message, rewrite(F.col(message)))
