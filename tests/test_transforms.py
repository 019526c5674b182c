import hashlib
import hmac
import json
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from signalspark.operators import chain as chains
from signalspark.operators import redact as r
from signalspark.operators import reduce as red
from signalspark.operators import templates as tpl
from signalspark.operators.jsonfilter import Cond, FilterConfig, json_filter

MESSAGES = [
    '{"n":1,"s":"12","t":"1d","b":true,"z":null,"o":{"p":"x"},"a":[1]}',
    '{"n":2.50,"s":"abc","o":{"p":7}}',
    "not json",
    '{"n":1} tail',
    None,
]


@pytest.mark.parametrize(
    "cond, matched",
    [
        (Cond("n", "eq", "1"), [0]),
        (Cond("n", "eq", "2.5"), [1]),
        (Cond("b", "eq", "true"), [0]),
        (Cond("z", "eq", "null"), [0]),
        (Cond("o", "eq", "x"), []),
        (Cond("n", "ne", "1"), [1]),
        (Cond("gone", "ne", "1"), [0, 1]),
        (Cond("z", "exists"), [0]),
        (Cond("gone", "exists"), []),
        (Cond("s", "gt", "11.5"), [0]),
        (Cond("t", "gt", "0"), []),
        (Cond("n", "lte", "2.5"), [0, 1]),
        (Cond("n", "gt", "many"), []),
        (Cond("b", "contains", "ru"), [0]),
        (Cond("z", "contains", "n"), []),
        (Cond("a", "contains", "1"), []),
        (Cond("o.p", "starts_with", "7"), [1]),
        (Cond("s", "ends_with", "c"), [1]),
        (Cond("s", "regex", r"^\d+$"), [0]),
        (Cond("n.deep", "exists"), []),
    ],
)
def test_json_conditions(rows, cond, matched):
    df = rows(list(enumerate(MESSAGES)), "id int, message string")
    kept = json_filter(df, FilterConfig("keep", "all", (cond,)))
    assert sorted(x.id for x in kept.collect()) == matched
    dropped = json_filter(df, FilterConfig("drop", "all", (cond,)))
    assert sorted(x.id for x in dropped.collect()) == [i for i in range(5) if i not in matched]


def test_filter_options_and_counters(rows):
    df = rows([(m,) for m in MESSAGES], "message string")
    config = FilterConfig.of({"field": "n", "value": "1", "match": "any", "conditions": [{"field": "s", "value": "abc"}]})
    seen = Observation()
    json_filter(df, config, observe=seen).collect()
    assert seen.get == {"received": 5, "passed": 3, "dropped": 2, "drop_rate": 0.4}
    for bad in ({}, {"field": "x"}, {"field": "x", "operator": "near", "value": "1"}, {"field": "", "value": "1"},
                {"field": "x", "value": "1", "action": "hide"}, {"field": "x", "value": "1", "match": "some"}):
        with pytest.raises(ValueError):
            FilterConfig.of(bad)


# --- redaction

HITS = {
    "email": ("write to user.name+tag@example.co.uk now", "not-an-email at example"),
    "phone": ("call +1-555-123-4567", "call 12"),
    "credit_card": ("card 4111 1111-11111111 ok", "card 411111111111"),
    "ssn_us": ("ssn 123-45-6789", "ssn 123-456-789"),
    "cpr_dk": ("cpr 010190-1234", "cpr 01011990-1234"),
    "nino_uk": ("nino AB123456C", "nino AB1234567C"),
    "bsn_nl": ("bsn 123456782", "bsn 1234567823"),
    "ipv4": ("from 192.168.1.1 port", "from 256.1.1.1.x"),
    "ipv6": ("from 2001:db8::8a2e:370:7334 on", "at 12:30"),
    "passport": ("pass X1234567", "pass x12"),
    "iban": ("iban GB82WEST12345698765432", "iban gb82west"),
}


@pytest.mark.parametrize("name", list(r.PATTERNS))
def test_each_pattern(rows, name):
    hit, miss = HITS[name]
    df = rows([(hit,), (miss,)], "text string")
    report = {x.pattern: x.matches for x in r.pii_report(df, "text", [name]).collect()}
    assert report == {name: 1}
    redacted = [x[0] for x in df.select(r.redact_text(F.col("text"), r.RedactConfig(patterns=(name,)))).collect()]
    assert "[REDACTED]" in redacted[0] and redacted[1] == miss


def reference_hash(value, key, prefix):
    number = int.from_bytes(hmac.new(key.encode(), value.encode(), hashlib.sha256).digest()[:12], "little")
    text = ""
    while number:
        number, digit = divmod(number, 62)
        text = r.ALPHABET[digit] + text
    return prefix + (text or "0")


def test_pseudonyms(rows):
    values = ["user@example.com", "", "ünï", "x" * 200, *[str(i) for i in range(50)]]
    df = rows([(v,) for v in values], "v string")
    for key in ("secret", "k" * 100):
        got = [x[0] for x in df.select(r.pseudonym(F.col("v"), key, "usr_")).collect()]
        assert got == [reference_hash(v, key, "usr_") for v in values]


def test_text_scan_replaces_found_strings_everywhere(rows):
    texts = ["a@b.co and xa@b.co", "ip 1.2.3.4, 1.2.3.44", "none", "+1-555-123-4567 a@b.co 555-123-4567", None]
    config = r.RedactConfig(patterns=("email", "ipv4", "phone"), strategy="hash", hash_key="k",
                            custom=(r.CustomPattern("word", "an+d", "w_"),))

    def wanted(text):
        result = text
        for regex, prefix in config.scanned():
            for match in re.finditer(regex, text):
                result = result.replace(match[0], reference_hash(match[0], "k", prefix))
        return result

    df = rows([(t,) for t in texts], "t string")
    got = [x[0] for x in df.select(r.redact_text(F.col("t"), config)).collect()]
    assert got == [wanted(t) if t else None for t in texts]
    as_messages = [x.t for x in r.redact(df, r.RedactConfig(**{**config.__dict__, "scan_all": True}), "t").collect()]
    assert as_messages == got


def redacted(rows, message, **options):
    return r.redact(rows([(message,)], "message string"), r.RedactConfig(**options)).first().message


def test_email_form_finds_the_same_matches(rows):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab.b@@- é1") for _ in range(rnd.randrange(40))) for _ in range(6000)]
    texts += ["a@b.cod.e@f.com", "x" * 200_000, "a@b.co@d.ef.gh@i.jk"]
    found = F.regexp_extract_all(F.col("t"), F.lit(r.java_regex(r.PATTERNS["email"])), F.lit(0))
    got = [x[0] for x in rows([(t,) for t in texts], "t string").select(found).collect()]
    short = [re.findall(r.PATTERNS["email"], t) if len(t) < 1000 else [] for t in texts]
    assert got == short and sum(map(len, got)) > 100


def test_targeted_fields(rows):
    message = json.dumps({"user": {"email": "me: a@b.co", "name": "a@b.co"}, "id": "EMP-77", "n": 5})
    fields = (r.Target("user.email", "email"), r.Target("id", "badge", "hash"), r.Target("n", "bsn_nl"), r.Target("no.way", "email"))
    found = json.loads(redacted(rows, message, fields=fields, hash_key="k", custom=(r.CustomPattern("badge", r"EMP-\d+", "emp_"),)))
    assert found == {"user": {"email": "[REDACTED]", "name": "a@b.co"}, "id": reference_hash("EMP-77", "k", "emp_"), "n": 5}
    # Only a named pattern counts, and text that is not JSON is left alone without a scan.
    assert redacted(rows, "a@b.co", fields=fields, hash_key="k") == "a@b.co"


def test_scan_reaches_every_string(rows):
    message = json.dumps({"z": ["a@b.co", {"k": "call a@b.co"}], "a@b.co": 1, "n": 1.50, "t": None})
    assert redacted(rows, message, patterns=("email",), scan_all=True) == (
        '{"a@b.co":1,"n":1.5,"t":null,"z":["[REDACTED]",{"k":"call [REDACTED]"}]}'
    )
    assert redacted(rows, "plain a@b.co", patterns=("email",), scan_all=True) == "plain [REDACTED]"


def test_redact_settings():
    for bad in ({}, {"patterns": ("nope",)}, {"patterns": ("email",), "strategy": "hash"}, {"patterns": ("email",), "strategy": "x"},
                {"fields": (r.Target("a", "email", "hash"),)}):
        with pytest.raises(ValueError):
            r.RedactConfig(**bad)
    with pytest.raises(ValueError):
        r.CustomPattern("x", "x", "")


def test_chain(rows):
    df = rows([('{"level":"debug"}',), ('{"level":"info","m":"a@b.co"}',)], "message string")
    steps = [
        {"type": "filter", "field": "level", "value": "debug"},
        {"type": "filter", "field": "level", "value": "info", "enabled": False},
        {"type": "redact", "patterns": ("email",), "scan_all": True},
        {"type": "noop"},
    ]
    assert [x.message for x in chains.chain(df, steps).collect()] == ['{"level":"info","m":"[REDACTED]"}']
    assert chains.names() == ["filter", "noop", "pattern_matcher", "redact", "reduce"]
    with pytest.raises(ValueError):
        chains.chain(df, [{"type": "unheard of"}])
    with pytest.raises(ValueError):
        chains.register("noop", lambda options: chains.noop)
    with pytest.raises(ValueError):  # a broken step fails even where it is switched off
        chains.chain(df, [{"type": "filter", "enabled": False}])


# --- reduction


def brute_groups(data, window, most):
    done, open_groups = [], {}
    for key, ts, number in sorted(data):
        group = open_groups.get(key)
        if group and ts - group[1] >= window:
            done.append(group)
            group = None
        if group is None:
            group = open_groups[key] = [key, ts, number, 0, ts]
        group[3] += 1
        group[4] = ts
        if group[3] == most:
            done.append(open_groups.pop(key))
    return sorted(map(tuple, [*done, *open_groups.values()]))


@pytest.mark.parametrize("trial", range(10))
def test_groups_match_brute_force(spark, rows, trial):
    rnd = random.Random(trial)
    keys, span = rnd.choice([1, 2, 30]), rnd.choice([5, 300, 5000])
    window, most = rnd.choice([1, 40, 10**9]), rnd.choice([1, 3, 20, 1000])
    # One key holds half of the rows, and ranges cut through it.
    data = [(f"k{rnd.randrange(keys) if rnd.random() < 0.5 else 0}", rnd.randrange(span), i) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        found = red.reduce_groups(rows(data, "k string, t bigint, id bigint"), "k", "t", window, most, ("id",), partitions=9)
        got = sorted((g.key, g.first_ts, g.id, g["count"], g.last_ts) for g in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_groups(data, window, most)


def reduced(rows, data, observe=None, **options):
    df = rows([(m, t) for t, m in enumerate(data)], "message string, ts bigint")
    config = red.ReduceConfig(**{"window_ms": 100, **options})
    return sorted(x.message for x in red.reduce_messages(df, config, ts="ts", observe=observe).collect())


def test_reduced_messages(rows):
    assert reduced(rows, ["a", "a", "a"], max_events=3) == ["a [_reduced_count=3]"]
    assert reduced(rows, ["a", "a"], min_events=3) == ["a"]
    assert reduced(rows, ["a", "b", "a"]) == ["a [_reduced_count=2]", "b"]
    nested = ['{"z":1,"error":{"code":5}}', '{"z":2,"error":{"code":5}}', '{"z":3,"error":{"code":"5"}}']
    assert reduced(rows, nested, group_by=("error.code",)) == [
        '{"_reduced_count":2,"_reduced_span_ms":1,"error":{"code":5},"z":1}',
        '{"z":3,"error":{"code":"5"}}',
    ]
    assert reduced(rows, ["[1]", "[1]"]) == ["[1] [_reduced_count=2]"]


def test_group_keys(rows):
    lines = ['{"a":1}', '{"a":1,"x":2}', '{"a":"1"}', '{"b":1}', "{}", '{"a":null}', "text", "fields:"]
    keyed = red.reduce_key(rows([(line,) for line in lines], "message string"), ("a", "b")).collect()
    keys = [x.key for x in keyed]
    assert keys[0] == keys[1] and len(set(keys)) == 7


def test_gap_of_one_window_starts_a_new_group(rows):
    df = rows([("a", 0), ("a", 99), ("a", 100), ("a", 199)], "message string, ts bigint")
    found = red.reduce_groups(df, "message", "ts", 100, 1000)
    assert sorted((g.first_ts, g["count"], g.last_ts) for g in found.collect()) == [(0, 2, 99), (100, 2, 199)]


def test_reduction_is_observed(rows):
    seen = Observation()
    reduced(rows, ["a"] * 8 + ["b"] * 2, observe=seen)
    assert seen.get == {"events": 10, "groups": 2, "reduction": 0.8}


def test_reduce_settings():
    for bad in ({"window_ms": 0}, {"max_events": 0}, {"min_events": 0}, {"min_events": 5, "max_events": 4}):
        with pytest.raises(ValueError):
            red.ReduceConfig(**bad)
    assert red.ReduceConfig() == red.ReduceConfig((), 5000, 1000, 2)


# --- log templates

VARIABLE = ["5", "-1.5e3", "1.", ".5", "inf", "NaN", "+7", "0x", "0xzz", "deadbeef1", "10.0.0.1", "+1.2.3.004", "a/b", "a\\b",
            "123e4567-e89b-12d3-a456-426614174000", "http://x", "a@b.c", "12:30", "1:23:45", "4294967295:1"]
CONSTANT = ["1d", "1f", "deadbeef", "256.1.1.1", "1.2.3", "a@b", "1:2", "123:", "4294967296:1", "user", "<*>", "e5", "+", "."]


def test_variable_words(rows):
    df = rows([(w,) for w in VARIABLE + CONSTANT], "w string").select("w", tpl.is_variable(F.col("w")).alias("v"))
    assert [x.w for x in df.collect() if x.v] == VARIABLE


def brute_ids(lines, threshold, variable):
    groups, ids = [], []
    for line in lines:
        words = line.split()
        if not words:
            ids.append(0)
            continue
        bucket = (len(words), "<*>" if variable(words[0]) else words[0])
        for number, (known, pattern) in enumerate(groups, 1):
            alike = sum(p is None or w == p or variable(w) for w, p in zip(words, pattern))
            if known == bucket and alike / len(words) >= threshold:
                ids.append(number)
                break
        else:
            groups.append((bucket, [None if variable(w) else w for w in words]))
            ids.append(len(groups))
    return ids


def logs_of(rows, lines):
    return rows([(i, line, datetime.fromtimestamp(1_700_000_000 + i // 3)) for i, line in enumerate(lines)],
                "id bigint, message string, timestamp timestamp")


def ids(clustering):
    return [x.pattern_id for x in clustering.assigned.orderBy("id").collect()]


@pytest.mark.parametrize("seed, threshold, chunk", [(1, 0.5, 1000), (2, 0.9, 7), (3, 0.3, 2), (4, 0.6, 5), (5, 1.0, 1), (6, 0.75, 1)])
def test_clusters_match_brute_force(rows, seed, threshold, chunk):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "d", "<*>"]
    lines = [
        " ".join(rnd.choice(words) if rnd.random() < 0.8 else str(rnd.randrange(99)) for _ in range(rnd.choice([0, 3, 4])))
        for _ in range(60)
    ]
    found = tpl.cluster(logs_of(rows, lines), order=("id",), threshold=threshold, chunk=chunk)
    assert ids(found) == brute_ids(lines, threshold, str.isdigit)
    assert found.registry.agg(F.sum("count")).first()[0] == sum(1 for line in lines if line.strip())


def bucket_of(seed, n, length, common, odd):
    """Distinct lines of one length and first word: base lines with words changed and places made variable."""
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, common, (max(n // 40, 1), length))
    lines = base[rnd.integers(0, len(base), n)]
    changed = rnd.random((n, length)) < rnd.choice([0.1, 0.4, 0.8], (n, 1))
    lines = np.where(changed, rnd.integers(0, odd, (n, length)), lines)
    variable = rnd.random((n, length)) < rnd.choice([0.0, 0.0, 0.2], (n, 1))
    variable |= (rnd.random((n, 1)) < 0.3) & (np.arange(length) == length - 1)
    return list(dict.fromkeys("job " + " ".join("7" if v else f"w{w}" for w, v in zip(x, y)) for x, y in zip(lines.tolist(), variable.tolist())))


def one_by_one(lines, threshold):
    """Ids of lines of one length that begin with the same word."""
    known = {"7": -1}
    rows = np.array([[known.setdefault(w, len(known)) for w in line.split()] for line in lines])
    founders, n, out = np.empty_like(rows), 0, []
    for row in rows:
        fits = ((founders[:n] == row) | (founders[:n] == -1) | (row == -1)).sum(1) / rows.shape[1] >= threshold
        first = int(fits.argmax()) if n and fits.any() else n
        if first == n:
            founders[n] = row
            n += 1
        out.append(first + 1)
    return out


@pytest.mark.parametrize("threshold, chunk, common, odd", [(0.5, 20, 60, 4000), (0.9, 50, 10, 500), (0.7, 5, 10, 30)])
def test_large_buckets_match_one_by_one(rows, threshold, chunk, common, odd):
    lines = bucket_of(chunk, 3000, 9, common, odd)
    found = ids(tpl.cluster(logs_of(rows, lines), order=("id",), threshold=threshold, chunk=chunk))
    expected = one_by_one(lines, threshold)
    assert max(expected) > 2 * chunk and found == expected


def test_query_over_free_text_matches_brute_force(spark):
    from catalog import QUERIES

    found = QUERIES["x29_cluster_text"](spark, "/root/testdata/sf0.01").collect()
    found.sort(key=lambda r: (r.conv_id, r.turn, r.line))
    words = sorted({w for r in found for w in r.message.split()})
    some = spark.createDataFrame([(w,) for w in words], "w string").where(tpl.is_variable(F.col("w"))).collect()
    variable = {r.w for r in some}
    assert [r.pattern_id for r in found] == brute_ids([r.message for r in found], 0.5, variable.__contains__)


def test_thresholds_and_names(rows):
    lines = ["user went to office", "user went to home", "module A started", "module B started", "1 2 3", " ", "user 5 went a b c d"]
    assert ids(tpl.cluster(logs_of(rows, lines), order=("id",), threshold=0.9)) == [1, 2, 3, 4, 5, 0, 6]
    found = tpl.cluster(logs_of(rows, lines), order=("id",), threshold=0.3)
    assert ids(found) == [1, 1, 2, 2, 3, 0, 4]
    named = {x.pattern_id: (x.template, x.canonical_name, x["count"]) for x in found.registry.collect()}
    assert named == {
        1: ("user went to office", "user went to office", 2),
        2: ("module A started", "module A started", 2),
        3: ("<*> <*> <*>", "Unknown Pattern", 1),
        4: ("user <*> went a b c d", "user went a b c", 1),
    }


def test_services_and_other_batch_types(rows):
    df = logs_of(rows, ["disk full 5", "disk full 6", "disk full 7"]).withColumns(
        {"service": F.when(F.col("id") == 1, F.lit("db")).when(F.col("id") == 2, F.lit("web")),
         "batch_type": F.when(F.col("id") == 0, "event").otherwise("log")}
    )
    assert ids(tpl.cluster(df, order=("id",))) == [1, 1, 1]
    assert ids(tpl.cluster(df, order=("id",), by_service="service")) == [1, 2, 3]
    assert ids(tpl.assign_patterns(df, order=("id",))) == [None, 1, 1]


@pytest.mark.parametrize("chunk", [1000, 1])
def test_registry_carries_over(spark, rows, tmp_path, chunk):
    first = tpl.cluster(logs_of(rows, ["job 1 done", "job 2 done", "job a b"]), order=("id",), threshold=0.9)
    tpl.save_registry(first.registry, str(tmp_path / "r"))
    seed = tpl.load_registry(spark, str(tmp_path / "r"))
    second = tpl.cluster(logs_of(rows, ["new thing", "job a b", "job 9 done"]), order=("id",), threshold=0.9, seed=seed, chunk=chunk)
    assert ids(second) == [3, 2, 1]
    counts = {x.pattern_id: x["count"] for x in second.registry.collect()}
    assert counts == {1: 3, 2: 2, 3: 1}


def test_a_registry_may_replace_the_one_it_was_made_from(spark, rows, tmp_path):
    folder = str(tmp_path / "r")
    tpl.save_registry(tpl.cluster(logs_of(rows, ["job 1 done", "job a b"]), order=("id",)).registry, folder)
    for n in range(4):
        seed = tpl.load_registry(spark, folder)
        tpl.save_registry(tpl.cluster(logs_of(rows, [f"extra {'x ' * n}y"]), order=("id",), seed=seed).registry, folder)
    assert sorted(r.pattern_id for r in tpl.load_registry(spark, folder).collect()) == [1, 2, 3, 4, 5]
    assert len(list((tmp_path / "r").glob("state-*"))) == 3 and not list((tmp_path / "r").glob("_attempt*"))
    with pytest.raises(FileNotFoundError):
        tpl.load_registry(spark, str(tmp_path / "none"))


def test_batches_of_a_stream_get_the_ids_of_one_batch(spark, rows, tmp_path):
    from signalspark.sinks.files import write_batch
    from signalspark.streaming.patterns import assign_batch, pattern_stream

    lines = bucket_of(8, 240, 5, 10, 40) + ["user 5 left", " ", "other words here"]
    whole = logs_of(rows, lines)
    options = {"order": ("id",), "threshold": 0.6, "chunk": 20}
    expected = dict(enumerate(ids(tpl.cluster(whole, **options))))
    cuts = [0, 70, 71, len(lines)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        whole.where(f"id >= {a} AND id < {b}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))

    def run(name):
        out, registry = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-registry")
        for i in range(3):  # a file a batch; the second and third are repeated after their registry was stored
            batch = spark.read.parquet(str(tmp_path / f"in/{i}"))
            for _ in range(1 + (i > 0)):
                assign_batch(batch, f"b{i}", registry, lambda df, b: write_batch(df, out, b), **options)
        return out, registry

    out, registry = run("batches")
    assert {r.id: r.pattern_id for r in spark.read.parquet(out).collect()} == expected
    counts = {r.pattern_id: r["count"] for r in tpl.load_registry(spark, registry).collect()}
    assert sum(counts.values()) == sum(1 for line in lines if line.strip())

    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    out = str(tmp_path / "stream-out")
    query = pattern_stream(
        stream.parquet(str(tmp_path / "in")), str(tmp_path / "stream-registry"), str(tmp_path / "checkpoint"),
        lambda df, name: write_batch(df, out, name), **options,
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: r.pattern_id for r in spark.read.parquet(out).collect()} == expected


# --- cases that went wrong once


def test_reduction_keeps_null_keys_apart(rows):
    from signalspark.operators.reduce import reduce_groups

    data = [(k, i * 10, i) for i, k in enumerate([None, "a", None, "a", "b", None])]
    for partitions in (1, 3, 6):
        found = reduce_groups(rows(data, "k string, ts bigint, id bigint"), "k", "ts", 1000, 100, ("id",), partitions)
        got = sorted((str(r.key), r["count"], r.first_ts, r.last_ts) for r in found.collect())
        assert got == [("None", 3, 0, 50), ("a", 2, 10, 30), ("b", 1, 40, 40)]


def test_json_redaction_survives_odd_messages(rows):
    from signalspark.operators import redact as r

    deep = "[" * 200_000 + '"a@b.com"' + "]" * 200_000
    data = [(0, deep), (1, '{"x":1e400,"m":"a@b.com"}'), (2, '{"m":"' + "a" * 1_000_000 + '"}'), (3, None), (4, '{"m":"x@y.de"}')]
    config = r.RedactConfig(patterns=("email",), scan_all=True)
    got = {x.id: x.message for x in r.redact(rows(data, "id int, message string"), config).collect()}
    assert "a@b.com" not in got[0] and got[0].startswith("[[[")
    assert got[1] == '{"x":1e400,"m":"[REDACTED]"}'
    assert got[2] == data[2][1] and got[3] is None and got[4] == '{"m":"[REDACTED]"}'


def test_json_redaction_of_lone_surrogates(rows):
    data = [(0, r'{"a":"\ud800","m":"a@b.com"}'), (1, r'{"a":"\ud800 a@b.com"}'), (2, r'["\udc00x"]'), (3, r'{"\ud800":1,"e":"é"}')]
    frame = rows(data, "id int, message string")
    scan = r.RedactConfig(patterns=("email",), scan_all=True)
    got = {x.id: x.message for x in r.redact(frame, scan).collect()}
    assert got == {
        0: r'{"a":"\ud800","m":"[REDACTED]"}', 1: r'{"a":"\ud800 [REDACTED]"}', 2: r'["\udc00x"]',
        3: r'{"e":"\u00e9","\ud800":1}',
    }
    field = r.RedactConfig(fields=(r.Target("a", "email"),), strategy="hash", hash_key="k")
    got = {x.id: x.message for x in r.redact(frame, field).collect()}
    assert "a@b.com" not in got[1] and "ud800" not in got[1] and got[3] == r'{"e":"\u00e9","\ud800":1}'


def test_reduction_puts_rows_without_a_time_apart(rows):
    data = [("a", None, 1), ("a", 5, 2), ("a", None, 3), ("a", 6, 4), ("b", None, 5)]
    found = red.reduce_groups(rows(data, "k string, ts bigint, id bigint"), "k", "ts", 1000, 100, ("id",)).collect()
    got = sorted((r.key, r.first_ts or -1, r.last_ts or -1, r["count"], r.id) for r in found)
    assert got == [("a", -1, -1, 1, 1), ("a", -1, -1, 1, 3), ("a", 5, 6, 2, 2), ("b", -1, -1, 1, 5)]


def test_number_text(rows):
    from signalspark.functions.jsondoc import number_text

    known = {
        0.0: "0.0", 1.0: "1.0", 1.5: "1.5", -2500.0: "-2500.0", 1e-7: "1e-7", 1.25e-7: "1.25e-7", 0.00012: "0.00012",
        1e15: "1000000000000000.0", 1e16: "1e16", 1.5e300: "1.5e300", 123456.789: "123456.789", 0.00001: "0.00001",
    }
    got = rows([(x,) for x in known], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == known


def test_a_micro_batch_of_one_file_is_shared_by_all_tasks(spark, rows, tmp_path, monkeypatch):
    from signalspark.streaming import patterns

    seen = []
    monkeypatch.setattr(patterns, "assign_batch", lambda batch, *more, **options: seen.append((batch.rdd.getNumPartitions(), batch.count())))
    made = rows([(i, f"word {i}") for i in range(100)], "event_id bigint, message string")
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    query = patterns.pattern_stream(stream, f"{tmp_path}/r", f"{tmp_path}/c", None).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(4, 100)]
