"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns a frame.

All but the last return the columns of their input. Null keys, repeated rows, empty texts and extra
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from signalspark.llm import bpe, decontaminate, langid, linededup, neardup

#: Bytes that a stage hands to Python at a time at most. Stages follow each other in the same executors, whose
#: memory holds a few such batches for every core. The setting stays, as what a stage returns is computed later.
BATCH = "4m"


def _small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def identify_language(spark, docs, sf_dir):
    """Learn languages from two thirds of the documents, and keep every document that has a learned
    language, several in one text included. Texts that are null or have no letter go."""
    _small_batches(spark)
    model = langid.learn(docs.where(langid.remainder("doc_id", 3) != 1))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = langid.identify(docs.select(rest.alias("row"), "text"), model, keep=["row", "text"])
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """Take later lines that are similar to an earlier one out of the texts."""
    _small_batches(spark)
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group of near copies, the one with the smallest id."""
    _small_batches(spark)
    return neardup.dedup(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Leave out documents that hold a benchmark item, with its own or with other values."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark, docs, sf_dir):
    """The documents as token ids with the text they decode to."""
    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]
