"""Substring dedup by relative Lempel-Ziv parsing of documents against an indexed reference.

The reference is all documents, cut into blocks. It is indexed by anchors: of every window of words the
run of words with the least hash, so that equal windows have equal anchors wherever they stand. The
index leads from an anchor to its first place: the smallest document that has it, and the position.

A document is parsed against every block that its anchors lead to: from the first anchor that no factor
covers yet, the longest run of equal words on both sides is a factor. A factor as long as a window is a
duplicate span if the block's document is smaller. At factor boundaries, windows whose anchor led to the
block but which reach beyond the factor are checked by themselves: no place of such a window is matched
by its anchor's first place, so all its places are found among these windows, and the smallest
document of each is counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small
from signalspark.llm.components import Bitmap, bitmap
from signalspark.llm.kernel import BLOCK, Words, _powers, blocks, flags_to_spans, mix, utf8
from signalspark.llm.shared import batches_of, landed

_U = np.uint64
_SECOND = _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 1 << 26
#: Words of documents' parts that are parsed at a time.
_PART_WORDS = 1 << 16


@dataclass(frozen=True)
class Settings:
    """window: words of a duplicate span at least; anchor: words of an anchor; block: words of a
    reference block."""

    window: int = 50
    anchor: int = 24
    block: int = 512


def _runs(batch):
    for some in small(batch):
        raw, offsets = utf8(some.column("__text"))
        for a, b in blocks(np.diff(offsets), BLOCK):
            yield some.slice(a, b - a), Words(raw, offsets[a : b + 1], lower=False)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = max(len(hashes) - size + 1, 0)
    powers, inverse = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes) * powers[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * inverse[:n] + _U(size)) if n else hashes[:0]


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the first of the least grams among so many from each place on, by doubling."""
    least, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = least[:-step], least[step:]
        least = np.where(grams[left] <= grams[right], left, right)
        reach += step
    return least


def anchors(words: Words, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position in the row of each anchor of a run of texts.

    Every window's anchor is the first of its least runs of words; it depends on the window's words only.
    """
    grams = _grams(words.hashes, settings.anchor)
    span = settings.window - settings.anchor + 1
    if len(grams) < span:
        return grams[:0], np.empty(0, np.int64), np.empty(0, np.int64)
    least = _least(grams, span)
    starts = np.arange(len(least))
    at = np.unique(least[starts + settings.window <= words.bounds[1:][words.row[starts]]])
    row = words.row[at]
    return grams[at], row, at - words.bounds[:-1][row]


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("__text"))


def _anchor_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """anchor, key, text_hash and pos of each anchor of each document."""

    def run(batches):
        for batch in batches:
            for some, words in _runs(batch):
                hashes, row, pos = anchors(words, settings)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), some.column(0).take(rows), some.column(1).take(rows), pa.array(pos.astype(np.int32))],
                    ["anchor", "key", "text_hash", "pos"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"anchor bigint, key {kind}, text_hash bigint, pos int")


def _document() -> Column:
    """A document's number for filters; equal rows are one document."""
    return F.xxhash64("key", "text_hash")


def _leads(rows: DataFrame, settings: Settings) -> DataFrame:
    """Per document, block of the reference and offset between the two: the positions of the anchors that
    lead there. rows: anchor rows."""
    # What is in one document only is left out by a filter of fixed size before places are compared.
    seen = rows.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n"), F.count("*").alias("m"))
    some = bitmap(seen.where("lo <> hi OR (n > 0 AND n < m)").select(F.col("anchor").alias("x")), _FILTER_BITS)
    sent = rows.sparkSession.sparkContext.broadcast(some)

    def shared(batches):
        passes = Bitmap(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(0).to_numpy())))

    rows = landed(rows.mapInArrow(shared, rows.schema), "shared-anchors")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "text_hash", "pos")
    first = rows.groupBy("anchor").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # An anchor of one document leads nowhere, however often it stands there.
    # It is written so that the join stands on its own and a very common anchor's places can be split.
    first = landed(first.where("NOT (first.key <=> last.key)").select("anchor", "first"), "first-places")
    found = rows.join(first, "anchor").where(
        "NOT (key <=> first.key AND text_hash = first.text_hash AND pos = first.pos)"
    )
    return found.groupBy(
        "key", "text_hash", F.col("first.key").alias("ref_key"), F.col("first.text_hash").alias("ref_hash"),
        F.expr(f"first.pos div {settings.block}").cast("int").alias("block"), (F.col("first.pos") - F.col("pos")).alias("offset"),
    ).agg(F.sort_array(F.collect_set("pos")).alias("at"))


def _cuts(docs: DataFrame, leads: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The blocks of the reference that are led to, and the documents' parts to be parsed against them.

    Every text that is needed is read and moved once: the parts that each document gives away, as one
    of the reference and as one to be parsed, are gathered by document before.
    """
    halo = settings.window
    none = F.lit(None)
    wanted = leads.select("ref_key", "ref_hash", "block").distinct()
    given = wanted.select(
        F.col("ref_key").alias("key"), F.col("ref_hash").alias("text_hash"),
        F.struct(
            none.cast(leads.schema["ref_key"].dataType).alias("ref_key"), none.cast("bigint").alias("ref_hash"), "block",
            none.cast("int").alias("offset"), none.cast("array<int>").alias("at"),
        ).alias("part"),
    )
    parsed = leads.select("key", "text_hash", F.struct("ref_key", "ref_hash", "block", "offset", "at").alias("part"))
    parts = given.unionAll(parsed).groupBy("key", "text_hash").agg(F.collect_list("part").alias("parts"))
    parts = landed(parts, "parts-by-document")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(parts.select(_document().alias("x")), _FILTER_BITS))

    def passing(batches):
        passes = Bitmap(sent.value)
        for batch in batches:
            yield batch.select([0, 1, 2]).filter(pa.array(passes(batch.column(3).to_numpy())))

    kind = docs.schema["key"].dataType.simpleString()
    some = docs.withColumn("d", _document()).mapInArrow(passing, f"key {kind}, text_hash bigint, __text string")
    some = some.dropDuplicates(["key", "text_hash"]).alias("d")
    same = F.col("d.key").eqNullSafe(F.col("p.key")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    both = some.join(parts.alias("p"), same).select("d.key", "d.text_hash", "__text", "parts")
    names = ["key", "text_hash", "ref_key", "ref_hash", "block", "offset", "at", "start", "words"]

    def cut(batches):
        for batch in batches:
            for some, words in _runs(batch):
                out = [[] for _ in names]
                keys, hashes = some.column(0).to_pylist(), some.column(1).to_pylist()
                for i, given in enumerate(some.column(3).to_pylist()):
                    own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                    for part in given:
                        if part["at"] is None:
                            start, end = part["block"] * settings.block - halo, (part["block"] + 1) * settings.block + halo
                            ref = keys[i], hashes[i]
                        else:
                            start, end = part["at"][0] - halo, part["at"][-1] + halo
                            ref = part["ref_key"], part["ref_hash"]
                        start = max(start, 0)
                        row = (keys[i], hashes[i], *ref, part["block"], part["offset"], part["at"], start, own[start:end].tobytes())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                first = some.schema.field(0).type
                kinds = [first, pa.int64(), first, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    made = f"key {kind}, text_hash bigint, ref_key {kind}, ref_hash bigint, block int, offset int, at array<int>, start int, words binary"
    made = landed(both.mapInArrow(cut, made), "word-parts")
    return made.where("at IS NULL").select("ref_key", "ref_hash", "block", "start", "words"), made.where("at IS NOT NULL")


def parse(
    words: np.ndarray, bounds: np.ndarray, ref: np.ndarray, ref_bounds: np.ndarray, shift: np.ndarray, anchor: np.ndarray,
    settings: Settings,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of some parts of documents, as (starts, ends), and starts of the windows at their boundaries.

    words: hashes of the parts' words one after another, part i's from bounds[i] to bounds[i + 1]; ref and
    ref_bounds: likewise the blocks that each is parsed against; shift: from a place in the part to that
    in the block; anchor: places of the anchors among ``words``. Only runs as long as a window are factors.
    """
    part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(words)) - bounds[:-1][part] + shift[part]
    inside = (place >= 0) & (place < np.diff(ref_bounds)[part])
    equal = np.zeros(len(words), bool)
    equal[inside] = words[inside] == ref[ref_bounds[:-1][part[inside]] + place[inside]]
    is_anchor = np.zeros(len(words) + 1, np.int64)
    is_anchor[anchor + 1] = 1
    breaks = np.zeros(len(words), bool)
    breaks[bounds[:-1][bounds[:-1] < len(words)]] = True
    begins, ends = flags_to_spans(equal, breaks)
    met = np.cumsum(is_anchor)
    long = (ends - begins >= settings.window) & (met[ends] > met[begins])
    grams, span = _grams(words, settings.anchor), settings.window - settings.anchor + 1
    if len(grams) < span:
        return begins[long], ends[long], np.empty(0, np.int64)
    least = _least(grams, span)
    starts = np.arange(len(least))
    whole = np.concatenate([[0], np.cumsum(equal)])
    loose = (is_anchor[least + 1] == 1) & (starts + settings.window <= bounds[1:][part[starts]])
    loose &= whole[starts + settings.window] - whole[starts] < settings.window
    return begins[long], ends[long], np.flatnonzero(loose)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in a binary column one after another, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(raw.tobytes(), _U), (offsets - offsets[0]) // 8


def duplicate_spans(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """key, text_hash, start and end of spans of words that a smaller document has, too; spans may overlap."""
    with batches_of(docs.sparkSession, "16m"):
        return _duplicate_spans(_prepared(docs, key, text), settings)


def _duplicate_spans(docs: DataFrame, settings: Settings) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()
    rows = landed(_anchor_rows(docs, settings), "anchors")
    leads = landed(_leads(rows, settings), "leads")
    reference, parts = _cuts(docs, leads, settings)
    r, p = reference.alias("r"), parts.alias("p")
    same = F.col("r.ref_key").eqNullSafe(F.col("p.ref_key")) & (F.col("r.ref_hash") == F.col("p.ref_hash"))
    # Of a block no more than the words that stand beside the part is handed on.
    skipped = F.greatest(F.col("p.start") + F.col("p.offset") - F.col("r.start"), F.lit(0))
    beside = F.substring(F.col("r.words"), 8 * skipped + 1, F.octet_length("p.words"))
    both = p.join(r, same & (F.col("r.block") == F.col("p.block"))).select(
        "p.key", "p.text_hash", "p.start", "p.words", (F.col("r.start") + skipped).alias("ref_start"), beside.alias("ref_words"),
        "p.offset", "p.at",
        (F.col("p.key").eqNullSafe(F.col("p.ref_key"))).alias("own"),
    )
    names = ["key", "text_hash", "start", "end", "h1", "h2"]

    def parsed(batch):
        words, bounds = _bytes(batch.column(3))
        ref, ref_bounds = _bytes(batch.column(5))
        start, ref_start, offset = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4, 6))
        own = batch.column(8).to_numpy(zero_copy_only=False)
        at = batch.column(7)
        edges = at.offsets.to_numpy()
        which = np.repeat(np.arange(len(start)), np.diff(edges))
        anchor = at.values.to_numpy()[edges[0] : edges[-1]] - start[which] + bounds[which]
        begins, ends, loose = parse(words, bounds, ref, ref_bounds, start + offset - ref_start, anchor, settings)
        of = np.searchsorted(bounds, begins, side="right") - 1
        begins, ends, of = (x[~own[of]] for x in (begins, ends, of))  # what a document has of itself only
        of_loose = np.searchsorted(bounds, loose, side="right") - 1
        rows = np.concatenate([of, of_loose])
        shift = (start - bounds[:-1])[rows]
        low = np.concatenate([begins, loose]) + shift
        high = np.concatenate([ends, loose + settings.window]) + shift
        none = pa.nulls(len(of), pa.int64())
        both = [_grams(w, settings.window)[loose].view(np.int64) if len(loose) else loose for w in (words, words ^ _SECOND)]
        rows = pa.array(rows)
        made = [pa.array(x.astype(np.int32)) for x in (low, high)] + [pa.concat_arrays([none, pa.array(h)]) for h in both]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *made], names)

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_numpy() // 8
            for a, b in blocks(sizes, _PART_WORDS):
                yield parsed(batch.slice(a, b - a))

    made = f"key {kind}, text_hash bigint, start int, end int, h1 bigint, h2 bigint"
    found = landed(both.mapInArrow(run, made), "factors")
    loose = found.where("h1 IS NOT NULL")
    order = F.struct(F.col("key").isNull().alias("none"), "key")
    first = loose.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    first = first.where("NOT (first <=> last)").select("h1", "h2", F.col("first.key").alias("first_key"))
    first = landed(first, "first-windows")
    again = loose.join(first, ["h1", "h2"]).where("NOT (key <=> first_key)")
    columns = ["key", "text_hash", "start", "end"]
    return found.where("h1 IS NULL").select(*columns).unionAll(again.select(*columns))


def dedup_substrings(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space) and
    ``spans``, the removed ones as (start, end) in words.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. A word goes if some window over it, of ``window`` words
    of its document, also stands in a document with a smaller key; windows are those of the whole input.
    Null and empty texts have no words. Rows of equal key are never duplicates of each other; a null key is
    larger than any other. Repeated rows stay and lose the same words. Words are compared by 64-bit
    hashes, one by one in factors and by 128 bits for whole windows. Other columns are not looked at.
    """
    spans = duplicate_spans(docs, settings, key, text)
    spans = spans.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = landed(spans, "duplicate-spans")
    rows = _prepared(docs, key, text).withColumn("d", _document())
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select(_document().alias("x")), _FILTER_BITS))
    kind = rows.schema["key"].dataType.simpleString()

    def chosen(with_spans: bool):
        def run(batches):
            passes = Bitmap(sent.value)
            for batch in batches:
                yield batch.select([0, 1, 2]).filter(pa.array(passes(batch.column(3).to_numpy()) == with_spans))

        return rows.mapInArrow(run, f"key {kind}, text_hash bigint, __text string")

    none = F.lit(None).cast(spans.schema["spans"].dataType)
    same = F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    with_spans = chosen(True).alias("d").join(spans.alias("s"), same, "left").select("d.key", "__text", "spans")
    # texts without a span are not moved
    rows = chosen(False).select("key", "__text", none.alias("spans")).unionAll(with_spans)

    def cut(batches):
        for batch in batches:
            for some in small(batch):
                raw, offsets = utf8(some.column("__text"))
                for a, b in blocks(np.diff(offsets), BLOCK):
                    words, data = Words(raw, offsets[a : b + 1], lower=False), raw[int(offsets[a]) : int(offsets[b])].tobytes()
                    part, out = some.slice(a, b - a), []
                    for i, found in enumerate(part.column(2).to_pylist()):
                        low, high = int(words.bounds[i]), int(words.bounds[i + 1])
                        gone = np.zeros(high - low + 1, np.int64)
                        for span in found or ():
                            gone[span["start"]] += 1
                            gone[span["end"]] -= 1
                        gone = np.cumsum(gone)[:-1] > 0
                        kept = np.flatnonzero(~gone) + low
                        pieces = [data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)]
                        runs = [{"start": int(s), "end": int(e)} for s, e in zip(*flags_to_spans(gone), strict=True)]
                        out.append((high - low, int(gone.sum()), b" ".join(pieces).decode(), runs))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", "n_words", "n_removed", "kept", "spans"])

    made = f"key {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:int,end:int>>"
    return rows.mapInArrow(cut, made).withColumnRenamed("key", key)
