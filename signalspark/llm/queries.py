"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import (
    bpe, decontaminate, hardneg, langid, linededup, neardup, quality, repair, substrings, token_counts, token_store, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op2_token_counts(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf, "documents"), path, 2048)


@query
def op9_bpe_roundtrip(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(table(spark, sf, "documents"), path)


@query
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = langid.remainder("doc_id", 3) == 1
    model = langid.learn(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query
def op7_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = langid.remainder("doc_id", 4) == 2
    model = toxicity.learn(docs, labels.where(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op8_warc_archive(spark, sf):
    archive = warc.write(table(spark, sf, "pages"))
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc_archive"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, bytes, max(page_id) AS first FROM p WHERE bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.bytes AS payload_bytes, p.sha AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.sha = p.sha AND f.bytes = p.bytes"""


@query
def op3_token_store(spark, sf):
    folder = token_store.write(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return token_store.checksums(token_store.starts(spark, folder)).withColumnRenamed("key", "doc_id")


@query
def op5_quality_rules(spark, sf):
    found = quality.judge(table(spark, sf, "documents")).withColumnRenamed("key", "doc_id")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_RATES = "\n".join(
    f", avg(k_{n} / n_docs) AS m_{n}, coalesce(var_samp(k_{n} / n_docs), 0) AS v_{n}" for n in quality.RULES
)
_WEIGHTS = "\n".join(
    f", CASE WHEN v_{n} > 1e-9 THEN greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, 1) ELSE 100 END AS w_{n}"
    for n in quality.RULES
)
_FAILED = " OR ".join(f"(k_{n} + m_{n} * w_{n}) / (n_docs + w_{n}) > 0.5" for n in quality.RULES)
ORACLES["op5_quality_rules"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM t LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*) AS n_docs
  {" ".join(f", sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS k_{n}" for n, rule in quality.RULES.items())}
  FROM m GROUP BY source),
a AS (SELECT 1 AS one {_RATES} FROM h),
b AS (SELECT * {_WEIGHTS} FROM a),
v AS (SELECT source, {_FAILED} AS host_failed FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) AS x
JOIN v ON v.source IS NOT DISTINCT FROM x.source"""


@query
def op6_decontaminate(spark, sf):
    """One row for each document and benchmark item that it leaks."""
    found = decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "n_slotted")


@query
def op4_minhash_dedup(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query
def op1_line_dedup(spark, sf):
    """One row per line of every document."""
    found = linededup.similar_lines(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "line", "n_tokens", "class_id", "n_links", "first_key", "first_line", "removed", "repeats"
    )


@query
def op12_conversation_repair(spark, sf):
    turns = table(spark, sf, "conversations")
    return repair.repair(repair.damage(turns), turns)


@query
def op11_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("key") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  list_inner_product(a.v, b.v)::BIGINT AS score FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


@query
def op13_substring_dedup(spark, sf):
    found = substrings.dedup_substrings(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
g AS (SELECT doc_id, i FROM h QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
r AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '))
    AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
