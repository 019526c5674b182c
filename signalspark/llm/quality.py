"""Quality rules per document and per host, in column expressions only.

Rules are judged per document; a host's share of documents that fail a rule is shrunk towards all
hosts' by a beta prior whose two numbers are fitted to the hosts' own rates by moments, so that a
host with few documents is judged by what is usual. A host that fails a rule takes its documents
with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import landed

_BLANK = r"[ \t\n\x0B\f\r]+"
#: Rules that may fail a document; a host fails a rule when its shrunk rate is above a half.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)",
}


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _windows(n: Column) -> Column:
    """Hash and place of every window of three words of ``__words``, in order of the hash."""
    return F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.struct(
                    F.xxhash64(F.get("__words", i - 1), F.get("__words", i), F.get("__words", i + 1)).alias("h"),
                    i.alias("i"),
                ),
            )
        ),
    )


def _repeated(windows: Column) -> Column:
    """Places of the windows that have an equal neighbour in hash order, ascending."""

    def marked(x, i):
        before = F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False))
        after = F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False))
        return F.struct(x["i"].alias("i"), (before | after).alias("same"))

    same = F.filter(F.transform(windows, marked), lambda x: x["same"])
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """How many words the windows at these ascending places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null texts count as empty; all counts are then 0. Lines are the parts between newlines that
    have a word; a null host is a host of its own.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").cast("string").alias("host"), body.alias("__text"))
    rows = rows.select("*", words(F.col("__text")).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.select(
        "key",
        "host",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("__text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        _windows(F.size("__words")).alias("__windows"),
    )
    rows = rows.withColumn("__places", _repeated(F.col("__windows")))
    return rows.select(
        "key",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("__places")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(rows: DataFrame, rules: dict[str, str] = RULES, limit: float = 0.5) -> DataFrame:
    """Per host: ``host``, ``n_docs``, the shrunk rate of each rule, and ``host_failed``.

    With k of n documents failing, the rate is (k + a) / (n + a + b); a and b come from the mean m
    and variance v of the hosts' rates: a + b = m (1 - m) / v - 1, at least 1, a = m (a + b). With one
    host, or equal rates, the prior weighs as much as a hundred documents.
    """
    fails = [F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"k_{name}") for name, rule in rules.items()]
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), *fails)
    rates = {name: F.col(f"k_{name}") / F.col("n_docs") for name in rules}
    moments = hosts.agg(
        *(F.avg(rate).alias(f"m_{name}") for name, rate in rates.items()),
        *(F.coalesce(F.var_samp(rate), F.lit(0.0)).alias(f"v_{name}") for name, rate in rates.items()),
    )
    joined = hosts.join(F.broadcast(moments))  # one row
    shrunk = {}
    for name in rules:
        m, v = F.col(f"m_{name}"), F.col(f"v_{name}")
        weight = F.when(v > 1e-9, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(100.0)
        shrunk[name] = (F.col(f"k_{name}") + m * weight) / (F.col("n_docs") + weight)
    failed = reduce(lambda a, b: a | b, (rate > limit for rate in shrunk.values()))
    return joined.select(
        "host", "n_docs", *(rate.alias(f"rate_{name}") for name, rate in shrunk.items()), failed.alias("host_failed")
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The measures of every row with ``base_failed``, ``host_failed`` and ``kept``.

    Base: fewer than 50 words, or more than half of the words in repeated windows. Rows are kept
    when neither they nor their host failed. Repeated rows are judged each; an empty table gives none.
    """
    rows = landed(measures(docs, key, text, host), "quality-measures")
    hosts = host_verdicts(rows).select("host", "host_failed")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    both = rows.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    return both.select("d.*", F.coalesce("h.host_failed", F.lit(False)).alias("host_failed")).select(
        "*", base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept")
    )
