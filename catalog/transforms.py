"""Transformers: JSON filter, redaction, reduction, log templates, chains."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog.base import messages, query, table, users
from catalog.base import logs as log_rows
from catalog.ingest import scratch
from signalspark.functions.filters import json_path
from signalspark.operators import chain as chains
from signalspark.operators import redact as r
from signalspark.operators import reduce as red
from signalspark.operators import templates as tpl
from signalspark.sinks.files import write_batch
from signalspark.streaming.patterns import pattern_stream
from signalspark.operators.jsonfilter import Cond, FilterConfig, json_filter
from signalspark.operators.tables import to_logs

def logs(spark, sf):
    return log_rows(spark, sf)


# --- JSON filter: (name, config, the kept rows in SQL)


def _text(path):
    return f"json_extract_string(message, '$.{path}')"


_SIZE = f"TRY_CAST({_text('size')} AS DOUBLE)"
_NOT_NULL = "coalesce({}, false)".format
FILTERS = [
    ("x1_filter_drop", FilterConfig("drop", "all", (Cond("level", "eq", "view"),)), f"NOT ({_text('level')} = 'view')"),
    ("x1_filter_keep", FilterConfig("keep", "all", (Cond("level", "eq", "view"),)), f"{_text('level')} = 'view'"),
    (
        "x2_filter_any",
        FilterConfig("keep", "any", (Cond("level", "eq", "error"), Cond("user.tier", "eq", "t1"))),
        f"{_text('level')} = 'error' OR {_text('user.tier')} = 't1'",
    ),
    (
        "x2_filter_all",
        FilterConfig("keep", "all", (Cond("level", "eq", "error"), Cond("user.tier", "eq", "t1"))),
        f"{_text('level')} = 'error' AND {_text('user.tier')} = 't1'",
    ),
    ("x3_eq_number", FilterConfig("keep", "all", (Cond("user.id", "eq", "7"),)), f"{_text('user.id')} = '7'"),
    ("x3_eq_flag", FilterConfig("keep", "all", (Cond("ok", "eq", "true"),)), f"{_text('ok')} = 'true'"),
    ("x3_eq_null", FilterConfig("keep", "all", (Cond("note", "eq", "null"),)), "json_type(message, '$.note') = 'NULL'"),
    ("x3_ne_missing", FilterConfig("keep", "all", (Cond("note", "ne", "n1"),)), f"coalesce({_text('note')}, '') <> 'n1'"),
    ("x4_contains", FilterConfig("keep", "all", (Cond("user.id", "contains", "12"),)), f"contains({_text('user.id')}, '12')"),
    ("x4_starts_with", FilterConfig("keep", "all", (Cond("level", "starts_with", "c"),)), f"starts_with({_text('level')}, 'c')"),
    ("x4_ends_with", FilterConfig("keep", "all", (Cond("ok", "ends_with", "ue"),)), f"ends_with({_text('ok')}, 'ue')"),
    ("x4_regex", FilterConfig("keep", "all", (Cond("size", "regex", "^[1-3]5$"),)), f"regexp_matches({_text('size')}, '^[1-3]5$')"),
    # Nested values never hold a text, so dropping on it keeps every row.
    ("x4_nested_never", FilterConfig("drop", "all", (Cond("user", "contains", "t"),)), "true"),
    ("x5_exists", FilterConfig("keep", "all", (Cond("note", "exists"),)), "json_type(message, '$.note') IS NOT NULL"),
    ("x6_gt", FilterConfig("keep", "all", (Cond("size", "gt", "49.5"),)), f"{_SIZE} > 49.5"),
    ("x6_lte", FilterConfig("keep", "all", (Cond("amount", "lte", "7.5"),)), f"TRY_CAST({_text('amount')} AS DOUBLE) <= 7.5"),
    ("x6_no_number", FilterConfig("drop", "all", (Cond("level", "lt", "5"),)), "true"),
]

for _name, _config, _where in FILTERS:

    @query(_name, f"SELECT event_id, message FROM v_messages WHERE {_NOT_NULL(_where)}")
    def _(spark, sf, config=_config):
        return json_filter(messages(spark, sf).drop("ts"), config)


# Numbers in several spellings, and how the parsed value prints.
_SPELLED = """concat('{"n":', CASE event_id % 8 WHEN 0 THEN '1.0' WHEN 1 THEN '1.50' WHEN 2 THEN '1e-7' WHEN 3 THEN
    '100000000000000000000000' WHEN 4 THEN '12345678901234567' WHEN 5 THEN '-2.50e3' WHEN 6 THEN '0.000120' ELSE '1' END, '}')"""
_PRINTED = """CASE event_id % 8 WHEN 0 THEN '1.0' WHEN 1 THEN '1.5' WHEN 2 THEN '1e-7' WHEN 3 THEN '1e23'
    WHEN 4 THEN '12345678901234567' WHEN 5 THEN '-2500.0' WHEN 6 THEN '0.00012' ELSE '1' END"""
for _name, _op, _value, _test in (
    ("x3_eq_whole", "eq", "1.0", "= '1.0'"),
    ("x3_ne_whole", "ne", "1", "<> '1'"),
    ("x4_number_ends", "ends_with", "5", "LIKE '%5'"),
    ("x4_number_contains", "contains", "e", "LIKE '%e%'"),
    ("x4_number_regex", "regex", r"^-?[0-9]+\.[0-9]+$", r"SIMILAR TO '-?[0-9]+\.[0-9]+'"),
    ("x4_number_starts", "starts_with", "0.00012", "= '0.00012'"),
):

    @query(_name, f"SELECT event_id FROM (SELECT event_id, {_PRINTED} AS n FROM v_messages) WHERE n {_test}")
    def _(spark, sf, op=_op, value=_value):
        spelled = table(spark, sf, "events").selectExpr("event_id", f"{_SPELLED} AS message")
        return json_filter(spelled, FilterConfig("keep", "all", (Cond("n", op, value),))).select("event_id")


@query("x7_json_path", f"SELECT event_id, {_text('user.tier')} AS tier FROM v_messages")
def _(spark, sf):
    return messages(spark, sf).select("event_id", F.get_json_object("message", json_path("user.tier")).alias("tier"))


@query("x8_non_json", "SELECT event_id FROM events WHERE event_type <> 'view' OR event_id % 2 = 1")
def _(spark, sf):
    # Every second message is cut short and so is no JSON: dropping by a condition keeps it.
    cut = "CASE WHEN event_id % 2 = 1 THEN substr(message, 1, 30) ELSE message END AS message"
    rows = messages(spark, sf).selectExpr("event_id", cut)
    return json_filter(rows, FilterConfig("drop", "all", (Cond("level", "eq", "view"),))).select("event_id")


@query("x10_observed_filter", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(spark, sf):
    config = FilterConfig("drop", "all", (Cond("level", "eq", "view"),))
    return json_filter(messages(spark, sf), config, observe=Observation()).select("event_id")


# --- redaction

_CONTACT = (
    "concat('{\"name\":\"', name, '\",\"user\":{\"email\":\"', email, '\",\"tags\":[\"', email, '\",\"', name, '\"]},\"ip\":\"10.0.',"
    " CAST(c_custkey % 256 AS STRING), '.7\"}') AS message"
)


def contacts(spark, sf):
    return users(spark, sf).selectExpr("c_custkey", _CONTACT)


@query(
    "x11_redact_fields",
    """SELECT c_custkey, concat('{"ip":"[REDACTED]","name":"', name, '","user":{"email":"[REDACTED]","tags":["', email,
        '","', name, '"]}}') AS message FROM v_users""",
)
def _(spark, sf):
    fields = (r.Target("user.email", "email"), r.Target("ip", "ipv4"), r.Target("name", "email"))
    return r.redact(contacts(spark, sf), r.RedactConfig(fields=fields))


@query(
    "x12_redact_scan",
    """SELECT c_custkey, concat('{"ip":"[REDACTED]","name":"', name, '","user":{"email":"[REDACTED]","tags":["[REDACTED]","',
        name, '"]}}') AS message FROM v_users""",
)
def _(spark, sf):
    return r.redact(contacts(spark, sf), r.RedactConfig(patterns=("email", "ipv4"), scan_all=True))


def _single(pattern):
    return pattern.replace("'", "''")


@query(
    "x13_redact_text",
    f"SELECT doc_id, regexp_replace(text, '{_single(r.PATTERNS['email'])}', '[REDACTED]', 'g') AS text FROM documents",
)
def _(spark, sf):
    config = r.RedactConfig(patterns=("email",))
    return table(spark, sf, "documents").select("doc_id", r.redact_text(F.col("text"), config).alias("text"))


@query("x13_redact_text_patterns")
def _(spark, sf):
    config = r.RedactConfig(patterns=("email", "phone", "ipv4", "iban"), strategy="hash", hash_key="k")
    return table(spark, sf, "conversations").select("conv_id", "turn", r.redact_text(F.col("text"), config).alias("text"))


@query("x14_redact_column", "SELECT c_custkey, '[REDACTED]' AS email, name FROM v_users")
def _(spark, sf):
    df = users(spark, sf).select("c_custkey", "email", "name")
    return r.redact_column(df, "email", "email", r.RedactConfig(patterns=("email",)))


def _pads(key):
    block = key.encode().ljust(64, b"\0")
    return ["unhex('" + bytes(b ^ pad for b in block).hex() + "')" for pad in (0x36, 0x5C)]


_INNER, _OUTER = _pads("secret-key")
_WORD = "CAST(concat('0x', {}) AS UBIGINT)::HUGEINT"
_LE = [
    "concat(" + ", ".join(f"substr(d, {2 * i + 1}, 2)" for i in reversed(range(4 * w, 4 * w + 4))) + ")"
    for w in (2, 1, 0)
]
_NUMBER = f"({_WORD.format(_LE[0])} * {2**64}::HUGEINT + {_WORD.format(_LE[1])} * {2**32}::HUGEINT + {_WORD.format(_LE[2])})"
_DIGITS = " || ".join(
    f"substr('{r.ALPHABET}', CAST((num // {62**i}::HUGEINT) % 62 + 1 AS INTEGER), 1)" for i in reversed(range(17))
)


@query(
    "x15_pseudonym",
    f"""SELECT c_custkey, concat('usr_', ltrim({_DIGITS}, '0')) AS email FROM (SELECT c_custkey, {_NUMBER} AS num FROM (
        SELECT c_custkey, sha256({_OUTER} || unhex(sha256({_INNER} || encode(email)))) AS d FROM v_users))""",
)
def _(spark, sf):
    df = users(spark, sf).select("c_custkey", "email")
    return r.redact_column(df, "email", "email", r.RedactConfig(strategy="hash", hash_key="secret-key", patterns=("email",)))


# DuckDB's word boundaries and classes are ASCII only. Around those, other letters are read as z, other
# digits as 0, other spaces as blanks and the rest as ~, which changes no match of these patterns.
_DECIMAL = "[٠-٩۰-۹०-९０-９]"
_SPACES = r"[\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PLAIN = f"regexp_replace(regexp_replace(text, '{_DECIMAL}', '0', 'g'), '{_SPACES}', ' ', 'g')"
_ASCII = (
    rf"regexp_replace(regexp_replace({_PLAIN}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]', '~', 'g'), '[^\x00-\x7F]', 'z', 'g')"
)
_READ_AS = {name: _ASCII if r"\b" in pattern else _PLAIN for name, pattern in r.PATTERNS.items()}
_READ_AS |= {"email": "text", "ipv6": "text"}


def _report_sql(name):
    found = f"len(regexp_extract_all({_READ_AS[name]}, '{_single(r.PATTERNS[name])}'))"
    return (
        f"SELECT '{name}' AS pattern, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches,"
        f" CAST(count(CASE WHEN n > 0 THEN 1 END) AS BIGINT) AS rows FROM (SELECT {found} AS n FROM documents)"
    )


for _name in r.PATTERNS:

    @query(f"x16_pattern_{_name}", _report_sql(_name))
    def _(spark, sf, name=_name):
        return r.pii_report(table(spark, sf, "documents"), "text", [name])


@query("x18_pii_report", " UNION ALL ".join(f"({_report_sql(n).replace('documents', 'conversations')})" for n in r.PATTERNS))
def _(spark, sf):
    return r.pii_report(table(spark, sf, "conversations"), "text")


# --- chains


@query(
    "x19_chain",
    """SELECT c_custkey, concat('{"ip":"10.0.', CAST(c_custkey % 256 AS VARCHAR), '.7","name":"', name,
        '","user":{"email":"[REDACTED]","tags":["', email, '","', name, '"]}}') AS message
        FROM v_users WHERE c_custkey % 10 <> 3""",
)
def _(spark, sf):
    steps = [
        {"type": "noop"},
        {"type": "filter", "field": "name", "operator": "ends_with", "value": "3"},
        {"type": "redact", "scan_all": True, "patterns": ("ipv4",), "enabled": False},
        {"type": "redact", "fields": (r.Target("user.email", "email"),)},
    ]
    return chains.chain(contacts(spark, sf), steps)


@query("x21_noop", "SELECT event_id, ts, message FROM v_messages")
def _(spark, sf):
    return chains.noop(messages(spark, sf))


# --- reduction


@query(
    "x22_reduce_key",
    f"""SELECT concat('fields:["level"]:"', {_text('level')}, '"', CASE WHEN json_type(message, '$.note') IS NULL THEN ''
        ELSE concat(',["note"]:', coalesce('"' || {_text('note')} || '"', 'null')) END) AS key, count(*) AS n
        FROM v_messages GROUP BY 1""",
)
def _(spark, sf):
    keyed = red.reduce_key(messages(spark, sf), ("level", "note"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x23_reduce_count",
    f"""SELECT key, CAST(count(*) AS BIGINT) AS count, arg_min(event_id, n) AS event_id FROM (SELECT {_text('level')} AS key, event_id,
        row_number() OVER (PARTITION BY {_text('level')} ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM v_messages)
        GROUP BY key, (n - 1) // 10""",
)
def _(spark, sf):
    rows = messages(spark, sf).select(F.get_json_object("message", "$.level").alias("k"), "ts", "event_id")
    groups = red.reduce_groups(rows, "k", "ts", 10**12, 10, ("event_id",))
    return groups.select("key", "count", "event_id")


_ORBIT = f"""WITH RECURSIVE numbered AS (
      SELECT {_text('level')} AS k, event_id, message, epoch_us(ts) // 1000 AS ms,
        row_number() OVER (PARTITION BY {_text('level')} ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM v_messages),
    firsts AS (SELECT k, ms, min(rn) AS rn FROM numbered GROUP BY 1, 2),
    linked AS (SELECT a.*, least(a.rn + 20, coalesce(b.rn, 1000000000)) AS following
      FROM numbered a ASOF LEFT JOIN firsts b ON a.k = b.k AND a.ms + 7200000 <= b.ms),
    starts AS (SELECT k, rn, following FROM linked WHERE rn = 1
      UNION ALL SELECT l.k, l.rn, l.following FROM starts s JOIN linked l ON l.k = s.k AND l.rn = s.following),
    made AS (SELECT s.k, s.rn, count(*) AS n, max(l.ms) - min(l.ms) AS span FROM starts s
      JOIN linked l ON l.k = s.k AND l.rn >= s.rn AND l.rn < s.following GROUP BY 1, 2)"""


@query(
    "x23_reduce_window",
    f"""SELECT * FROM ({_ORBIT} SELECT m.k AS key, CAST(m.n AS BIGINT) AS count, CAST(m.span AS BIGINT) AS span, f.event_id
        FROM made m JOIN numbered f ON f.k = m.k AND f.rn = m.rn)""",
)
def _(spark, sf):
    rows = messages(spark, sf).select(F.get_json_object("message", "$.level").alias("k"), "ts", "event_id")
    groups = red.reduce_groups(rows, "k", "ts", 7_200_000, 20, ("event_id",))
    return groups.select("key", "count", (F.col("last_ts") - F.col("first_ts")).alias("span"), "event_id")


@query(
    "x24_reduce_messages",
    f"""SELECT * FROM ({_ORBIT} SELECT f.event_id, CASE WHEN m.n < 3 THEN concat('{{"lvl":"', f.k, '"}}')
        ELSE concat('{{"_reduced_count":', CAST(m.n AS VARCHAR), ',"_reduced_span_ms":', CAST(m.span AS VARCHAR),
            ',"lvl":"', f.k, '"}}') END AS message
        FROM made m JOIN numbered f ON f.k = m.k AND f.rn = m.rn)""",
)
def _(spark, sf):
    text = F.concat(F.lit('{"lvl":"'), F.get_json_object("message", "$.level"), F.lit('"}'))
    rows = messages(spark, sf).select("event_id", "ts", text.alias("message"))
    config = red.ReduceConfig(("lvl",), 7_200_000, 20, 3)
    return red.reduce_messages(rows, config, ts="ts", order=("event_id",)).select("event_id", "message")


@query(
    "x24_reduce_text",
    """SELECT message, count(*) AS n FROM (SELECT CASE WHEN count(*) < 2 THEN t ELSE concat(t, ' [_reduced_count=',
        CAST(count(*) AS VARCHAR), ']') END AS message FROM (SELECT t, row_number() OVER (PARTITION BY t ORDER BY ts, event_id)
        AS n FROM (SELECT ts, event_id, concat('got ', event_type, ' in ', CAST(user_id % 9 AS VARCHAR)) AS t FROM events))
        GROUP BY t, (n - 1) // 7) GROUP BY 1""",
)
def _(spark, sf):
    text = "concat('got ', event_type, ' in ', CAST(user_id % 9 AS STRING)) AS message"
    rows = table(spark, sf, "events").selectExpr("event_id", "ts", text)
    reduced = red.reduce_messages(rows, red.ReduceConfig((), 10**12, 7, 2), ts="ts", order=("event_id",))
    return reduced.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x25_flush_all",
    "SELECT level, CAST(sum(1) AS BIGINT) AS events FROM v_logs GROUP BY 1",
)
def _(spark, sf):
    groups = red.reduce_groups(logs(spark, sf).select("level", "timestamp", "event_id"), "level", "timestamp", 60_000, 50,
                               ("event_id",))
    return groups.groupBy(F.col("key").alias("level")).agg(F.sum("count").alias("events"))


_DAY_GROUPS = """WITH RECURSIVE numbered AS (
      SELECT level AS k, event_id, epoch_us(timestamp) // 1000 AS ms,
        row_number() OVER (PARTITION BY level ORDER BY epoch_us(timestamp) // 1000, event_id) AS rn FROM v_logs),
    firsts AS (SELECT k, ms, min(rn) AS rn FROM numbered GROUP BY 1, 2),
    linked AS (SELECT a.*, least(a.rn + 50, coalesce(b.rn, 1000000000)) AS following
      FROM numbered a ASOF LEFT JOIN firsts b ON a.k = b.k AND a.ms + 86400000 <= b.ms),
    starts AS (SELECT k, rn, following FROM linked WHERE rn = 1
      UNION ALL SELECT l.k, l.rn, l.following FROM starts s JOIN linked l ON l.k = s.k AND l.rn = s.following)
    SELECT s.k AS level, arg_min(l.event_id, l.rn) AS event_id, count(*) AS count, min(l.ms) AS first_ts, max(l.ms) AS last_ts
    FROM starts s JOIN linked l ON l.k = s.k AND l.rn >= s.rn AND l.rn < s.following GROUP BY s.k, s.rn"""


@query("x25_flush_groups", f"SELECT * FROM ({_DAY_GROUPS})")
def _(spark, sf):
    """Every group, those open at the end of the input included."""
    rows = logs(spark, sf).select("level", "timestamp", "event_id")
    groups = red.reduce_groups(rows, "level", "timestamp", 86_400_000, 50, ("event_id",))
    return groups.select(F.col("key").alias("level"), "event_id", "count", "first_ts", "last_ts")


# --- log templates

_FLOAT = r"[+-]?((?i:inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_VARIABLE = f"""(regexp_full_match(w, '{_FLOAT}') OR starts_with(w, '0x') OR regexp_full_match(w, '[0-9a-fA-F]{{9,}}')
    OR regexp_full_match(w, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') OR (length(w) = 36 AND regexp_full_match(w,
    '[0-9a-fA-F]*(-[0-9a-fA-F]*){{4}}')) OR contains(w, '/') OR contains(w, '\\') OR (contains(w, '@') AND contains(w, '.'))
    OR (length(w) >= 5 AND regexp_full_match(w, '[0-9]{{1,9}}(:[0-9]{{1,9}})+')))"""


def _masked(text):
    words = rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CASE WHEN {_VARIABLE} THEN '<*>' ELSE w END)"


def _template(text):
    return f"coalesce(array_to_string({_masked(text)}, ' '), '')"


@query(
    "x27_variable_words",
    rf"""SELECT w AS word, {_VARIABLE} AS is_variable, count(*) AS n FROM (
        SELECT unnest(string_split_regex(text, '\s+')) AS w FROM conversations) WHERE w <> '' GROUP BY 1, 2""",
)
def _(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(tpl.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word", tpl.is_variable(F.col("word")).alias("is_variable")).agg(F.count(F.lit(1)).alias("n"))


@query("x28_template_logs", f"SELECT {_template('message')} AS template, count(*) AS n FROM v_logs GROUP BY 1")
def _(spark, sf):
    return logs(spark, sf).groupBy(tpl.mask_template(F.col("message")).alias("template")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("x28_template_text", f"SELECT conv_id, turn, {_template('text')} AS template FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tpl.mask_template(F.col("text")).alias("template"))


def _ids(partition="", where="true"):
    keys = f"{partition}{', ' if partition else ''}template"
    return f"""(SELECT {keys}, row_number() OVER (ORDER BY first) AS pattern_id FROM (SELECT {keys}, min((timestamp, event_id)) AS first
        FROM (SELECT *, {_template('message')} AS template FROM v_logs WHERE {where}) GROUP BY {keys}))"""


@query(
    "x29_cluster",
    f"SELECT event_id, pattern_id FROM (SELECT event_id, {_template('message')} AS template FROM v_logs) JOIN {_ids()} USING (template)",
)
def _(spark, sf):
    return tpl.cluster(logs(spark, sf), order=("event_id",), threshold=0.9).assigned.select("event_id", "pattern_id")


@query(
    "r7_logs_table",
    f"""SELECT timestamp, upper(level) AS level, CAST(CASE level WHEN 'ERROR' THEN 3 WHEN 'NOTICE' THEN 5 WHEN 'INFO'
        THEN 6 WHEN 'DEBUG' THEN 7 ELSE 8 END AS INTEGER) AS severity, source, service, session_id, pattern_id,
        message, message AS _raw FROM (SELECT *, {_template('message')} AS template FROM v_logs) JOIN {_ids()} USING (template)""",
)
def _(spark, sf):
    """Log rows stored with the ids that clustering gave them."""
    assigned = tpl.cluster(logs(spark, sf), order=("event_id",), threshold=0.9).assigned
    return to_logs(assigned.withColumn("payload", F.col("message"))).drop("source_ip")


@query("x29_cluster_default", "SELECT event_id, CAST(1 AS BIGINT) AS pattern_id FROM v_logs")
def _(spark, sf):
    return tpl.cluster(logs(spark, sf), order=("event_id",)).assigned.select("event_id", "pattern_id")


@query("x29_cluster_text")
def _(spark, sf):
    lines = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "message")
    )
    return tpl.cluster(lines, ts="conv_id", order=("turn", "line")).assigned


@query(
    "x31_registry",
    f"""SELECT pattern_id, i.template, concat_ws(' ', 'User did', string_split(i.template, ' ')[4], 'from request') AS canonical_name,
        c.count, c.first_seen, c.last_seen FROM {_ids()} i JOIN (SELECT {_template('message')} AS template,
        count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM v_logs GROUP BY 1) c USING (template)""",
)
def _(spark, sf):
    return tpl.pattern_registry(logs(spark, sf), order=("event_id",), threshold=0.9).drop("service", "tokens")


@query(
    "x31_template_counts",
    f"""SELECT {_template('message')} AS template, concat_ws(' ', 'User did', arg_min(string_split(message, ' ')[4], event_id),
        'from request') AS canonical_name, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
        FROM v_logs GROUP BY 1""",
)
def _(spark, sf):
    return tpl.template_counts(logs(spark, sf))


@query(
    "x32_logs_only",
    f"""SELECT event_id, pattern_id FROM (SELECT event_id, {_template('message')} AS template FROM v_logs WHERE event_id % 2 = 0)
        JOIN {_ids(where='event_id % 2 = 0')} USING (template)
        UNION ALL SELECT event_id, NULL FROM v_logs WHERE event_id % 2 = 1""",
)
def _(spark, sf):
    rows = logs(spark, sf).selectExpr("*", "CASE WHEN event_id % 2 = 0 THEN 'log' ELSE 'event' END AS batch_type")
    found = tpl.assign_patterns(rows, order=("event_id",), threshold=0.9)
    return found.assigned.select("event_id", "pattern_id")


@query(
    "x33_by_service",
    f"""SELECT event_id, pattern_id FROM (SELECT event_id, service, {_template('message')} AS template FROM v_logs)
        JOIN {_ids('service')} USING (service, template)""",
)
def _(spark, sf):
    found = tpl.cluster(logs(spark, sf), order=("event_id",), threshold=0.9, by_service="service")
    return found.assigned.select("event_id", "pattern_id")


_FIRST_HALF = "timestamp < TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "x34_stored_registry",
    f"""SELECT event_id, pattern_id FROM (SELECT event_id, {_template('message')} AS template FROM v_logs WHERE NOT {_FIRST_HALF})
        JOIN {_ids(where=_FIRST_HALF)} USING (template)""",
)
def _(spark, sf):
    half = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp_ntz")
    path = scratch(spark, "registry")
    first = tpl.cluster(logs(spark, sf).where(half), order=("event_id",), threshold=0.9)
    tpl.save_registry(first.registry, path)
    seed = tpl.load_registry(spark, path)
    second = tpl.cluster(logs(spark, sf).where(~half), order=("event_id",), threshold=0.9, seed=seed)
    return second.assigned.select("event_id", "pattern_id")


@query(
    "x34_stream_registry",
    f"SELECT event_id, pattern_id FROM (SELECT event_id, {_template('message')} AS template FROM v_logs) JOIN {_ids()} USING (template)",
)
def _(spark, sf):
    """Ids given micro-batch by micro-batch, each going on from the registry that the last one left."""
    rows, folder = logs(spark, sf).select("event_id", "timestamp", "message"), scratch(spark, "pattern-stream")
    for number, day in enumerate(("2024-01-10", "2024-01-20", "2024-02-10")):
        before = ("2024-01-01", "2024-01-10", "2024-01-20")[number]
        part = rows.where(f"timestamp >= TIMESTAMP_NTZ '{before}' AND timestamp < TIMESTAMP_NTZ '{day}'")
        part.write.parquet(f"{folder}/in/part={number}")
        # All files that have come since the last run are one micro-batch, read side by side.
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*")
        query = pattern_stream(
            stream, f"{folder}/registry", f"{folder}/checkpoint", lambda df, name: write_batch(df, f"{folder}/out", name),
            order=("event_id",), threshold=0.9,
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "pattern_id")
