"""Log templates: mask the variable words of a message, group alike templates, keep a registry.

Grouping is greedy in order of first occurrence: a template joins the first earlier group of the
same length and first word that agrees with it in enough places, else it founds a group. Messages
enter this only through their masked form, so it runs on the distinct masked templates.

Templates of large buckets meet through an inverted index of (bucket, place, word). Two templates may
differ in a fixed number d of places; of any d + 1 places that are constant in both, one must therefore
hold the same word in both. Which places these are goes by the pair of shapes (which places are
variable), the ones with most different words first. Pairs of shapes with no more than d constant places
in common always fit and need no index: there the earliest founder of a shape stands for all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.functions.jsondoc import NUMBER, computed_once
from signalspark.session import ensure_checkpoint_dir
from signalspark.sinks.versions import read_state, write_state

VARIABLE = "<*>"
UNNAMED = "Unknown Pattern"
NAME_WORDS = 5
DEFAULT_THRESHOLD = 0.5

# Templates per bucket that the first round resolves one by one in a task. What fits none of their
# founders has few that fit each other, so that a later round may take GROWTH times as many.
CHUNK = 1000
GROWTH = 8
# The most that a round takes of a bucket: its founders are kept in one task's memory.
LARGEST = 1 << 18
# Up to this many rows, a side of a join is small enough to be sent to every task.
SMALL = 100_000


def _at_most(limit: str) -> str:
    """A regex for decimal digits, leading zeros allowed, whose value does not exceed ``limit``."""
    shorter = rf"[0-9]{{1,{len(limit) - 1}}}"
    below = [
        rf"{limit[:i]}[0-{int(d) - 1}][0-9]{{{len(limit) - i - 1}}}" for i, d in enumerate(limit) if d != "0"
    ]
    return rf"\+?0*(?:{'|'.join([*below, limit, shorter])})"


_BYTE, _COUNT = _at_most("255"), _at_most("4294967295")

# Words that vary from message to message.
_VARIABLE_WORDS = [
    NUMBER,
    r"0x.*",
    r"[0-9a-fA-F]{9,}",
    rf"{_BYTE}(?:\.{_BYTE}){{3}}",
    r"(?=.{36}\z)[0-9a-fA-F]*(?:-[0-9a-fA-F]*){4}",
    r".*[/\\].*",
    r"(?=.*@)(?=.*\.).*",
    rf"(?=.{{5,}}){_COUNT}(?::{_COUNT})+",
]
_VARIABLE = rf"(?s)^(?:{'|'.join(_VARIABLE_WORDS)})\z"


def is_variable(token: Column) -> Column:
    """Numbers, hex, addresses, UUIDs, paths, URLs, mail addresses and clock times."""
    return token.rlike(_VARIABLE)


def tokens(message: Column) -> Column:
    return F.filter(F.split(message, r"(?U)\s+"), lambda token: token != "")


def masked_tokens(message: Column) -> Column:
    """The words of a message, with null for each variable one."""
    return F.transform(tokens(message), lambda token: F.when(~is_variable(token), token))


def template_text(masked: Column) -> Column:
    return F.array_join(masked, " ", VARIABLE)


def mask_template(message: Column) -> Column:
    return template_text(masked_tokens(message))


def canonical_name(masked: Column) -> Column:
    """The first five constant words, or a stand-in when there are none."""
    words = F.slice(F.filter(masked, lambda word: word.isNotNull()), 1, NAME_WORDS)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.lit(UNNAMED))


def similarity(left: Column, right: Column) -> Column:
    """Share of places in which two templates of one length have the same word or either a variable."""

    def agree(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | b.isNull() | (a == b), 1).otherwise(0)

    agreeing = F.aggregate(F.zip_with(left, right, agree), F.lit(0), lambda total, one: total + one)
    return agreeing / F.size(left)


@dataclass(frozen=True)
class Clustering:
    """``assigned``: the messages with their ``pattern_id``; ``registry``: one row per pattern."""

    assigned: DataFrame
    registry: DataFrame


_BUCKET = ["service", "words", "head"]


def _bucketed(df: DataFrame) -> DataFrame:
    """Only templates of one service, length and first word can meet."""
    head = F.coalesce(F.element_at("masked", 1), F.lit(VARIABLE))
    return df.withColumn("words", F.size("masked")).withColumn("head", head)


def _group(masked: list, threshold: float) -> list[int]:
    """For each template of a bucket, in order of first occurrence, the index of its group's founder."""
    if len(masked) == 1:
        return [0]
    words: dict[str, int] = {}
    rows = np.array([[-1 if w is None else words.setdefault(w, len(words)) for w in line] for line in masked])
    founders = np.empty_like(rows)
    founded: list[int] = []
    leader = []
    for i, row in enumerate(rows):
        known = founders[: len(founded)]
        agreeing = ((known == row) | (known == -1) | (row == -1)).sum(axis=1)
        fits = np.flatnonzero(agreeing / rows.shape[1] >= threshold)
        if len(fits):
            leader.append(founded[fits[0]])
        else:
            founders[len(founded)] = row
            founded.append(i)
            leader.append(i)
    return leader


def _fold(threshold: float):
    """Group sorted buckets of at most ``CHUNK`` templates, one bucket in memory at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, places, masked = None, [], []
        done: list[tuple[int, int]] = []

        def flush() -> None:
            done.extend(zip(places, [places[i] for i in _group(masked, threshold)]))

        for frame in frames:
            rows = zip(frame["service"], frame["words"], frame["head"], frame["place"], frame["masked"])
            for *bucket, place, line in rows:
                if bucket != key:
                    if places:
                        flush()
                    key, places, masked = bucket, [], []
                places.append(place)
                masked.append(line)
            yield pd.DataFrame(done, columns=["place", "leader"])
            done = []
        if places:
            flush()
        yield pd.DataFrame(done, columns=["place", "leader"])

    return run


def _numbered(df: DataFrame, order: list[str], name: str, above: int = 0) -> DataFrame:
    """Consecutive numbers along a global order: a range sort, and an offset per partition."""
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part")).checkpoint()
    ordered = ordered.withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    offsets, total = [], above
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["n"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset bigint")
    numbered = ordered.join(F.broadcast(table), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_index") + 1).drop("_part", "_index", "_offset")


def _shaped(df: DataFrame) -> DataFrame:
    """shape: a mark for each place after the first one, 1 where it is variable."""
    rest = F.slice("masked", 2, F.size("masked"))
    return df.withColumn("shape", F.array_join(F.transform(rest, lambda w: F.when(w.isNull(), "1").otherwise("0")), ""))


def _needed(words: Column, threshold: float) -> Column:
    """The least number of agreeing places whose share reaches the threshold."""
    up = F.ceil(F.lit(threshold) * words).cast("int")
    return F.when((up - 1) / words >= threshold, up - 1).otherwise(up)


def _places(templates: DataFrame) -> DataFrame:
    """Per bucket, ``by``: its places after the first one, those with most different words first."""
    rest = F.slice("masked", 2, F.size("masked"))
    words = templates.select(*_BUCKET, F.posexplode(rest).alias("at", "word"))
    counted = words.groupBy(*_BUCKET, "at").agg(F.approx_count_distinct("word").alias("n"))
    ranked = counted.groupBy(*_BUCKET).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "at"))).alias("by"))
    return ranked.select(*_BUCKET, F.transform("by", lambda x: x["at"]).alias("by"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _shape_pairs(later: DataFrame, earlier: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """Pairs of shapes within a bucket, ``shape`` and ``other``, with the places to look up; null: always fit."""
    a = later.select(*_BUCKET, "shape").distinct()
    b = earlier.select(*[F.col(c).alias(f"_{c}") for c in _BUCKET], F.col("shape").alias("other")).distinct()
    both = a.join(b, a["service"].eqNullSafe(b["_service"]) & (a["words"] == b["_words"]) & (a["head"] == b["_head"]))
    both = both.select(*_BUCKET, "shape", "other")
    both = both.join(places, _null_safe(both, places), "left").select(*[both[c] for c in both.columns], "by")

    def constant(at: Column) -> Column:
        return (F.substring("shape", at + 1, F.lit(1)) == "0") & (F.substring("other", at + 1, F.lit(1)) == "0")

    free = F.col("words") - _needed(F.col("words"), threshold)
    shared = F.filter(F.coalesce("by", F.array().cast("array<int>")), constant)
    return both.select(*_BUCKET, "shape", "other", F.when(F.size(shared) > free, F.slice(shared, 1, free + 1)).alias("at"))


def _index(rows: DataFrame, pairs: DataFrame, mine: str) -> DataFrame:
    """A row for each token under which a template looks for others (mine: shape) or is found (other)."""
    some = pairs.where("at IS NOT NULL").select(
        *_BUCKET, F.col(mine).alias("mine"), F.col("shape").alias("of_later"), F.col("other").alias("of_earlier"), "at"
    )
    some = _sent(some)
    found = rows.join(some, _null_safe(rows, some) & (rows["shape"] == some["mine"])).select(
        *[rows[c] for c in (*_BUCKET, "place", "masked")], "of_later", "of_earlier", F.explode("at").alias("at")
    )
    word = F.get("masked", F.col("at") + 1)
    return found.select(F.xxhash64(*_BUCKET, "of_later", "of_earlier", "at", word).alias("token"), *_BUCKET, "place", "masked")


def _fitting(later: DataFrame, earlier: DataFrame, pairs: DataFrame, threshold: float, ordered: bool) -> DataFrame:
    """(place, leader) of templates that fit and were met in the index; ordered: leaders come first."""
    w, f = _index(later, pairs, "shape").alias("w"), _index(earlier, pairs, "other").alias("f")
    same = (F.col("w.token") == F.col("f.token")) & (F.col("w.words") == F.col("f.words"))
    same &= (F.col("w.head") == F.col("f.head")) & F.col("w.service").eqNullSafe(F.col("f.service"))
    if ordered:
        same &= F.col("f.place") < F.col("w.place")
    met = w.join(f, same).where(similarity(F.col("f.masked"), F.col("w.masked")) >= threshold)
    return met.select(F.col("w.place").alias("place"), F.col("f.place").alias("leader"))


def _earliest(waiting: DataFrame, founders: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """``waiting`` with its earliest founder that fits as ``leader``, null if none does."""
    pairs = _shape_pairs(waiting, founders, places, threshold).checkpoint()
    met = _fitting(waiting, founders, pairs, threshold, False).groupBy("place").agg(F.min("leader").alias("met"))
    firsts = founders.groupBy(*_BUCKET, "shape").agg(F.min("place").alias("first")).withColumnRenamed("shape", "other")
    always = pairs.where("at IS NULL")
    always = always.join(firsts, _null_safe(always, firsts, [*_BUCKET, "other"])).select(
        *[always[c] for c in (*_BUCKET, "shape")], "first"
    )
    always = _sent(always.groupBy(*_BUCKET, "shape").agg(F.min("first").alias("first")))
    joined = waiting.join(always, _null_safe(waiting, always, [*_BUCKET, "shape"]), "left")
    joined = joined.select(*[waiting[c] for c in waiting.columns], "first").join(met, "place", "left")
    return joined.withColumn("leader", F.least("met", "first")).drop("met", "first")


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide templates in order, bucket by bucket: each has the earlier ones that fit it (``fits``) and the
    shapes that always do (``always``); only founders are kept in memory."""
    key, founders, firsts = None, set(), {}
    for frame in frames:
        done = []
        for *bucket, place, shape, fits, always in zip(*(frame[c] for c in (*_BUCKET, "place", "shape", "fits", "always"))):
            if bucket != key:
                key, founders, firsts = bucket, set(), {}
            near = [f for f in (() if fits is None else fits) if f in founders]
            near += [firsts[s] for s in (() if always is None else always) if s in firsts]
            done.append((place, min(near) if near else place))
            if not near:
                founders.add(place)
                firsts.setdefault(shape, place)
        yield pd.DataFrame(done, columns=["place", "leader"])


def _in_order(taken: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(place, leader) of templates none of which fits an earlier founder."""
    pairs = _shape_pairs(taken, taken, places, threshold).checkpoint()
    fits = _fitting(taken, taken, pairs, threshold, True).groupBy("place").agg(F.collect_set("leader").alias("fits"))
    always = _sent(pairs.where("at IS NULL").groupBy(*_BUCKET, "shape").agg(F.collect_set("other").alias("always")))
    rows = taken.join(always, _null_safe(taken, always, [*_BUCKET, "shape"]), "left")
    rows = rows.select(*[taken[c] for c in (*_BUCKET, "place", "shape")], "always").join(fits, "place", "left")
    rows = rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "place")
    return rows.mapInPandas(_follow, "place bigint, leader bigint")


_HALVES = [0.5**k for k in range(1, 41)]


def _taken(waiting: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The earliest templates of each bucket, up to ``size``, and how many buckets have more.

    Of larger buckets at least half as many are taken: up to a place found among approximate quantiles.
    """
    cuts = F.percentile_approx("place", F.lit(_HALVES), 10_000)
    sizes = waiting.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")).where(F.col("n") > size)
    sizes = sizes.select(*_BUCKET, F.get("cuts", F.ceil(F.log2(F.col("n") / size)).cast("int") - 1).alias("cut")).checkpoint()
    buckets = sizes.count()
    if not buckets:
        return waiting, 0
    sizes = F.broadcast(sizes) if buckets <= SMALL else sizes
    marked = waiting.join(sizes, _null_safe(waiting, sizes), "left").select(*[waiting[c] for c in waiting.columns], "cut")
    return marked.where("cut IS NULL OR place <= cut").drop("cut"), buckets


def _resolve(templates: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(place, leader) for every template; a leader is itself the place of a template.

    A round takes the earliest templates of each bucket and finds the founders among them. What is left
    of larger buckets comes later than all of these, so it can be matched against the founders in any
    order; only templates that fit none wait for the next round, which takes GROWTH times as many.
    """
    resolved, waiting, size, places = None, _shaped(templates), chunk, None
    while True:
        taken, buckets = _taken(waiting, size)
        if size == chunk:
            rows = taken.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "place").select(*_BUCKET, "place", "masked")
            grouped = rows.mapInPandas(_fold(threshold), "place bigint, leader bigint").checkpoint()
        else:
            grouped = _in_order(taken, places, threshold).checkpoint()
        resolved = grouped if resolved is None else resolved.unionByName(grouped)
        if not buckets:
            return resolved
        places = _places(waiting).checkpoint() if places is None else places
        rest = waiting.join(grouped.select("place"), "place", "left_anti")
        founders = waiting.join(grouped.where("place = leader").select("place"), "place")
        matched = _earliest(rest, founders, places, threshold).checkpoint()
        resolved = resolved.unionByName(matched.where("leader IS NOT NULL").select("place", "leader"))
        waiting = matched.where("leader IS NULL").drop("leader")
        size = min(size * GROWTH, max(LARGEST, chunk))


def _adopt(templates: DataFrame, earlier: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Templates that fit a pattern of an earlier run, with its id, and those that fit none."""
    templates, earlier = _shaped(templates), _shaped(earlier)
    places = _places(templates.select(*_BUCKET, "masked").unionAll(earlier.select(*_BUCKET, "masked")))
    matched = _earliest(templates, earlier, places, threshold).checkpoint()
    adopted = matched.where("leader IS NOT NULL").select("place", F.col("leader").alias("pattern_id"))
    return adopted, matched.where("leader IS NULL").drop("leader", "shape")


def _null_safe(left: DataFrame, right: DataFrame, columns=_BUCKET) -> Column:
    condition = None
    for column in columns:
        test = left[column].eqNullSafe(right[column])
        condition = test if condition is None else condition & test
    return condition


def cluster(
    df: DataFrame, message: str = "message", ts: str = "timestamp", order: tuple[str, ...] = (),
    threshold: float = DEFAULT_THRESHOLD, by_service: str | None = None, seed: DataFrame | None = None,
    only: Column | None = None, chunk: int = CHUNK,
) -> Clustering:
    """Give every message the id of its pattern; blank messages get 0, null ones none.

    ``order`` settles messages of the same time. ``by_service`` keeps the services in that column
    apart. ``seed`` is the registry of an earlier run: its patterns come first and keep their ids.
    Rows for which ``only`` does not hold get no id.
    """
    ensure_checkpoint_dir(df.sparkSession)
    threshold = min(max(threshold, 0.0), 1.0)
    text = F.col(message) if only is None else F.when(only, F.col(message))
    service = F.col(by_service).cast("string") if by_service else F.lit(None).cast("string")
    masked = computed_once(df, masked_tokens(text).alias("_masked")).withColumn("_service", service)

    place = F.struct(*[F.col(c) for c in (ts, *order)])
    seen = masked.where(F.size("_masked") > 0).groupBy("_service", "_masked").agg(
        F.min(place).alias("first"),
        F.count(F.lit(1)).alias("count"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )
    distinct = seen.withColumnsRenamed({"_service": "service", "_masked": "masked"})
    distinct = _bucketed(_numbered(distinct, ["first", "service", "masked"], "place")).drop("first")

    known = 0
    fresh, adopted = distinct, None
    if seed is not None:
        known = seed.agg(F.max("pattern_id")).first()[0] or 0
        earlier = _bucketed(seed.select("service", F.col("tokens").alias("masked"), F.col("pattern_id").alias("place")))
        adopted, fresh = _adopt(distinct, earlier, threshold)

    pairs = _resolve(fresh, threshold, max(chunk, 1))
    leaders = _numbered(pairs.where("place = leader").select("leader"), ["leader"], "pattern_id", known)
    ids = pairs.join(leaders, "leader").select("place", "pattern_id")
    if adopted is not None:
        ids = ids.unionByName(adopted)
    named = distinct.join(ids, "place")

    lookup = named.select(F.col("service").alias("_service"), F.col("masked").alias("_masked"), "pattern_id")
    same = masked["_service"].eqNullSafe(lookup["_service"]) & (masked["_masked"] == lookup["_masked"])
    assigned = masked.join(lookup, same, "left").select(
        *[masked[c] for c in df.columns],
        F.when(F.size(masked["_masked"]) == 0, F.lit(0)).otherwise(F.col("pattern_id")).cast("bigint").alias("pattern_id"),
    )
    return Clustering(assigned, _registry(named, leaders, seed))


def _registry(named: DataFrame, leaders: DataFrame, seed: DataFrame | None) -> DataFrame:
    counted = named.groupBy("pattern_id").agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    founders = leaders.join(named.drop("pattern_id"), leaders["leader"] == named["place"])
    made = founders.select("pattern_id", "service", F.col("masked").alias("tokens"))
    rows = made.join(counted, "pattern_id")
    if seed is not None:
        again = seed.select("pattern_id", "service", "tokens", "count", "first_seen", "last_seen")
        more = counted.select("pattern_id", *[F.col(c).alias(f"_{c}") for c in ("count", "first_seen", "last_seen")])
        merged = again.join(more, "pattern_id", "left").select(
            "pattern_id",
            "service",
            "tokens",
            (F.col("count") + F.coalesce("_count", F.lit(0))).alias("count"),
            F.least("first_seen", "_first_seen").alias("first_seen"),
            F.greatest("last_seen", "_last_seen").alias("last_seen"),
        )
        rows = merged.unionByName(rows)
    return rows.select(
        "pattern_id",
        "service",
        "tokens",
        template_text(F.col("tokens")).alias("template"),
        canonical_name(F.col("tokens")).alias("canonical_name"),
        "count",
        "first_seen",
        "last_seen",
    )


def assign_patterns(df: DataFrame, **options) -> Clustering:
    """``cluster`` over the log rows of a mixed frame; rows of other batch types are left without an id."""
    return cluster(df, only=F.col("batch_type") == "log", **options)


def pattern_registry(df: DataFrame, **options) -> DataFrame:
    return cluster(df, **options).registry


def template_counts(df: DataFrame, message: str = "message", ts: str = "timestamp") -> DataFrame:
    """Distinct masked templates with their name, count and first and last time."""
    masked = df.select(masked_tokens(F.col(message)).alias("masked"), F.col(ts).alias("ts"))
    grouped = masked.groupBy("masked").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return grouped.select(
        template_text(F.col("masked")).alias("template"),
        canonical_name(F.col("masked")).alias("canonical_name"),
        "count",
        "first_seen",
        "last_seen",
    )


def save_registry(registry: DataFrame, path: str) -> None:
    """Store a registry as the folder's newest state; it may come from an earlier state of the same folder."""
    write_state(registry, path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete registry in a folder."""
    found = read_state(spark, path)
    if found is None:
        raise FileNotFoundError(f"no registry in {path}")
    return found
