"""Token ids as Parquet list columns.

Documents are range-partitioned by id, so the files, taken in order, hold them in ascending order.
Ids are dictionary-encoded, the numbers beside them delta-encoded; row groups and pages are small
enough that page indexes let a reader fetch some documents, or the numbers without the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.llm.bpe import encode_texts, small, texts_of
from signalspark.llm.shared import shared_folder

#: Names of the Parquet writer's settings.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#key": "false",
    "parquet.enable.dictionary#begin": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.page.row.count.limit": "2000",
    "parquet.block.size": str(32 << 20),
}


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text"
) -> str:
    """Encode every whole text, append ``end_id`` and write the ids; returns the folder.

    Columns of the files: key, shard (the number of the file), begin (ids before the document in
    its file), n_tokens (with the end id), ids. Null texts are empty and have the end id alone; null
    keys come first; rows of equal key follow each other in order of a hash of their text. Other
    columns are not written. An empty table gives files without rows.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("__text"))
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    rows = rows.repartitionByRange("key", "__tie").sortWithinPartitions("key", "__tie").drop("__tie")

    def run(batches):
        from pyspark import TaskContext

        shard, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in small(batch):
                found = list(encode_texts(tokenizer, texts_of(some, "__text")))
                sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
                ends = begin + np.cumsum(sizes)
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.full(int(edges[-1]), end_id, np.int32)
                inside = np.ones(len(flat), bool)
                inside[edges[1:] - 1] = False
                flat[inside] = np.concatenate(found)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))
                shards = pa.array(np.full(len(found), shard, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), shards, pa.array(ends - sizes), pa.array(sizes), ids],
                    ["key", "shard", "begin", "n_tokens", "ids"],
                )
                begin = int(ends[-1])

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, shard int, begin bigint, n_tokens bigint, ids array<int>")
    made.write.options(**LAYOUT).parquet(folder)
    return folder


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """key, shard, begin, n_tokens and start, the ids of all documents before; the ids are not read.

    The files' sizes, one row for each, are sent to every task, so that the ids need no shuffle.
    """
    rows = spark.read.parquet(folder)
    files = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(files), "shard").withColumn("start", F.col("begin") + F.col("__before")).drop("__before")


def checksums(stored: DataFrame) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            edges = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    kind = stored.schema["key"].dataType.simpleString()
    picked = stored.select("key", "start", "n_tokens", "ids")
    return picked.mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
