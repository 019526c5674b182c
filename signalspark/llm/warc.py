"""WARC archives: a deterministic, sharded writer and a reader.

Shards are ranges of the record order, cut at quantiles of a sample picked by hash, so the same
table gives the same files wherever it runs. A task streams its shards into gzip members and starts
a new file once the compressed size is reached. Files are written under names of their attempt; the
manifest, a table written by Spark, names those of the attempts that succeeded, and only these get
their final names. A lost executor leaves files that no manifest names. Readers go by the manifest.

Records with equal payloads are written once: the one with the largest id is the response, the
others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm.shared import landed, shared_folder

#: Records carry a fixed date, since the table has none and the files must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "shard int, part int, temporary string, name string, records bigint, bytes bigint, sha256 string"


@dataclass
class Archive:
    """A written archive: its folder and the manifest of its files."""

    folder: str
    manifest: DataFrame


def _open(folder: str):
    """The file system of a folder and the folder's path in it; works for any store Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uuid(key: int | None, order: int, nth: int) -> str:
    """The same record has the same id in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{order}/{nth}')}>"


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(own: str, key: int | None, url: str | None, payload: bytes, refers_to: int | None, target: str | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with its headers only."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if target else 'response'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if key is None else key}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if target:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: {target}")
        head.insert(8, f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class _File:
    """One output file of an attempt, closed with its line of the manifest."""

    def __init__(self, system, folder: str, shard: int, part: int, attempt: str):
        self.shard, self.part = shard, part
        self.name = f"shard-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"_attempts/{attempt}-{self.name}"
        system.create_dir(f"{folder}/_attempts", recursive=True)
        self.out = system.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.records += 1
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        return (self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest())


def _bounds(light: DataFrame, shards: int, sample: int) -> list[tuple[int, int]]:
    """Upper bounds of the shards in (id, order): quantiles by bytes of a sample picked by hash."""
    import numpy as np

    if shards < 2:
        return []
    picked = light.orderBy(F.xxhash64("__key", "__order"), "__key", "__order").limit(sample)
    rows = picked.select("__key", "__order", "__bytes").toArrow()
    key, order, size = (c.to_numpy() for c in rows.columns)
    at = np.lexsort((order, key))
    run = np.cumsum(size[at] + 500)
    cuts = np.searchsorted(run, run[-1] * np.arange(1, shards) / shards)
    return sorted({(int(key[i]), int(order[i])) for i in at[cuts]})


def write(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
    shard_bytes: int = 32 << 20, roll_bytes: int = 256 << 20, least_bytes: int = 1000, sample: int = 500_000,
) -> Archive:
    """Write one record per row, in order of ``key``, and return the committed archive.

    Null payloads are empty, null urls empty; a null key counts as the smallest. Rows of equal key
    and equal payload are ordered by a hash of the url; of equal payloads of ``least_bytes`` or more
    the last in this order is the response. Other columns are ignored; an empty table gives an
    archive without files. shard_bytes: payload in a shard, about; roll_bytes: a file is closed when
    its compressed size reaches this. sample bounds the rows that choose the shard bounds, and there
    is one shard for twenty of these at most.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    low = -(1 << 63)
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(low)).alias("__key"),
        F.xxhash64(F.col(f"`{url}`"), body).alias("__order"),
        F.col(f"`{url}`").cast("string").alias("__url"),
        body.alias("__body"),
    )
    light = landed(
        rows.select(
            "__key", "__order", F.octet_length("__body").cast("long").alias("__bytes"), F.sha1("__body").alias("__sha")
        ),
        "warc-digests",
    )
    size = light.agg(F.sum("__bytes")).first()[0] or 0
    shards = max(1, min(-(-size // shard_bytes), sample // 20))
    bounds = _bounds(light, shards, sample)
    copies = (
        light.where(F.col("__bytes") >= least_bytes)
        .groupBy("__sha", "__bytes")
        .agg(F.max(F.struct("__key", "__order")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    revisits = light.join(copies, ["__sha", "__bytes"]).where(F.struct("__key", "__order") != F.col("first"))
    marks = revisits.groupBy("__key", "__order").agg(F.first("first").alias("first"))
    empty, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    both = rows.select(
        "__key", "__order", F.lit(1).alias("__kind"), "__url", "__body", none.alias("__to"), none.alias("__to_order")
    ).unionByName(
        marks.select(
            "__key", "__order", F.lit(0).alias("__kind"), empty.alias("__url"), empty.alias("__body"),
            F.col("first.__key").alias("__to"), F.col("first.__order").alias("__to_order"),
        )
    )
    schema = both.schema
    edges = spark.sparkContext.broadcast(bounds)

    def shard_of(batches):
        from bisect import bisect_left

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            shard = pa.array([bisect_left(edges.value, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], ["__shard", *batch.schema.names])

    dealt = both.mapInArrow(shard_of, "__shard int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    dealt = dealt.repartition(len(bounds) + 1, "__shard").sortWithinPartitions("__shard", "__key", "__order", "__kind", "__url")

    def pack(batches):
        system, root = _open(folder)
        attempt, file, done = uuid.uuid4().hex, None, []
        place, mark, nth = None, None, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for shard, page, order, kind, link, text, to, to_order in zip(*columns, strict=True):
                if (page, order) != place:
                    place, mark, nth = (page, order), None, 0
                if kind == 0:  # stands before the rows it is about
                    mark = (to, to_order)
                    continue
                if file is not None and (file.shard != shard or file.bytes >= roll_bytes):
                    done.append(file.close())
                    file = _File(system, root, shard, file.part + 1 if file.shard == shard else 0, attempt)
                elif file is None:
                    file = _File(system, root, shard, 0, attempt)
                payload = text.encode()
                refers = mark or (place if nth and len(payload) >= least_bytes else None)
                target = refers and _uuid(_shown(refers[0]), refers[1], 0)
                own = _uuid(_shown(page), order, nth)
                file.add(record(own, _shown(page), link, payload, refers and _shown(refers[0]), target))
                nth += 1
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=_arrow_manifest())

    manifest = landed(dealt.mapInArrow(pack, _MANIFEST), "warc-manifest")
    _commit(manifest, folder)
    return Archive(folder, manifest)


def _shown(key: int) -> int | None:
    return None if key == -(1 << 63) else key


def _arrow_manifest() -> pa.Schema:
    whole, text = pa.int64(), pa.string()
    kinds = [pa.int32(), pa.int32(), text, text, whole, whole, text]
    return pa.schema(list(zip([f.split()[0] for f in _MANIFEST.split(", ")], kinds, strict=True)))


def _commit(manifest: DataFrame, folder: str) -> None:
    """Give the files of the manifest their final names; may run again after a failure."""
    from pyarrow import fs

    def rename(batches):
        system, root = _open(folder)
        for batch in batches:
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                elif system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name} was neither written nor committed")
            yield batch.select([1])

    manifest.select("temporary", "name").mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()


def _members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(step):
        parts.append(inflate.decompress(data))
        rest = b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, body[: int(fields["Content-Length"])]


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records of an archive: page_id, url, record_type, payload (null for revisits),
    payload_bytes, payload_digest (hex), refers_to.

    The digest is checked against the payload where there is one; a record that does not match
    raises an error, as does a file with another number of records than the manifest says.
    """
    folder = archive.folder
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def unpack(batches):
        system, root = _open(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        row = _row(member)
                        seen += 1
                        held += len(row[3] or b"") + 200
                        rows.append(row)
                        if held > 4 << 20:
                            yield _table(rows, schema)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, its manifest says {records}")
                if rows:
                    yield _table(rows, schema)

    files = archive.manifest.select("name", "records")
    files = files.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 10_000)), "name")
    made = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    return files.mapInArrow(unpack, made)


def _row(member: bytes) -> tuple:
    fields, block = _parse(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its headers")
    page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id", "")
    return (
        int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], None if revisit else payload,
        length, digest.hex(), int(to) if to else None,
    )


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
