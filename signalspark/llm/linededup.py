"""Line dedup by an exact set-similarity join.

The tokens of a line are its shingles. Every line's tokens are ordered from rare to common; lines
that reach the threshold must share a token among their first n - ceil(t n) + 1 (prefix filter), be
of similar size (length filter), and have enough tokens left behind the shared one (positional
filter). What passes is verified on the full sets. Rarity is counted over all lines in a count-min
sketch of fixed size: any order gives the same links, a good one keeps common tokens out of prefixes.

Lines of equal sets are one node, so copies are never expanded into pairs. Every pair of nodes that the
filters leave is verified, within a component too: links are counted, weighted by copies, and a line
goes when it is linked with an earlier one itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small
from signalspark.llm.components import Bitmap, bitmap, components
from signalspark.llm.kernel import BLOCK, HashIndex, Words, blocks, differ, mix, parities, utf8
from signalspark.llm.shared import landed, packed, same_row

_U = np.uint64
_ID_BITS = 46
_SKETCH = 1 << 16
_CHUNK = 1 << 12
_BITS = ("p0", "p1", "p2", "p3")


@dataclass(frozen=True)
class Settings:
    """percent: least similarity in percent; shingle: words in a token (a shorter line is one token)."""

    percent: int = 75
    shingle: int = 5


def _runs(batch):
    for some in small(batch):
        raw, offsets = utf8(some.column("__text"))
        for a, b in blocks(np.diff(offsets), BLOCK):
            yield some.slice(a, b - a), Words(raw, offsets[a : b + 1], lines=True)


def _tokens(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, row = words.shingles(k)
    return hashes >> _U(64 - _ID_BITS), row


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids & _U(_SKETCH - 1)).astype(np.int64), ((ids >> _U(16)) & _U(_SKETCH - 1)).astype(np.int64)


def _token_sets(ids: np.ndarray, row: np.ndarray, rows: int, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rare ones first, and where each line's begin."""
    level = np.zeros(len(ids), _U)
    if levels is not None:
        a, b = _slots(ids)
        level = np.minimum(levels[0][a], levels[1][b]).astype(_U)
    packed = (level << _U(_ID_BITS)) | ids
    out, sizes = [], np.zeros(rows, np.int64)
    edges = np.searchsorted(row, np.arange(0, rows + _CHUNK, _CHUNK)).tolist()
    for at, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            local = np.sort(((row[a:b] - at * _CHUNK).astype(_U) << _U(52)) | packed[a:b])
            local = local[np.concatenate([[True], local[1:] != local[:-1]])]
            found = np.bincount((local >> _U(52)).astype(np.int64))
            sizes[at * _CHUNK : at * _CHUNK + len(found)] = found
            out.append(local & _U((1 << _ID_BITS) - 1))
    return (np.concatenate(out) if out else ids[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _nodes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each set, 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(values + _U(0x2545F4914F6CDD1D)))])
    size = np.diff(starts).astype(_U)
    return np.where(size > 0, mix(sums[starts[1:]] - sums[starts[:-1]] + size), _U(0)).view(np.int64)


def _lines(docs: DataFrame, settings: Settings) -> tuple[DataFrame, np.ndarray]:
    """The lines, and how rare their tokens are, from one pass over the texts.

    Lines: key, text_hash, line (from 0), n_tokens and node; node 0 for lines without words. Rarity: two
    rows of 65,536 levels (logarithms of counts) of all tokens of all lines; every task ends with its counts.
    """
    names = ["key", "text_hash", "line", "n_tokens", "node", "slot", "n"]
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        counts, key_type = np.zeros((2, _SKETCH), np.int64), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for some, words in _runs(batch):
                ids, row = _tokens(words, settings.shingle)
                for i, slot in enumerate(_slots(ids)):
                    counts[i] += np.bincount(slot, minlength=_SKETCH)
                values, starts = _token_sets(ids, row, words.rows, None)
                text = pa.array(words.row_text)
                columns = [some.column(0).take(text), some.column(1).take(text), pa.array(words.row_line.astype(np.int64))]
                columns += [pa.array(np.diff(starts)), pa.array(_nodes(values, starts))]
                columns += [pa.nulls(words.rows, pa.int32()), pa.nulls(words.rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if key_type is not None:
            flat = counts.reshape(-1)
            at = np.flatnonzero(flat)
            columns = [pa.nulls(len(at), key_type), *(pa.nulls(len(at), pa.int64()) for _ in range(4))]
            columns += [pa.array(at.astype(np.int32)), pa.array(flat[at])]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = f"key {kind}, text_hash bigint, line bigint, n_tokens bigint, node bigint, slot int, n bigint"
    made = landed(docs.mapInArrow(run, kinds), "lines")
    found = made.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 131,072 rows at most
    counts = np.zeros(2 * _SKETCH, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    levels = np.minimum(1.5 * np.log2(counts + 1), 63).astype(np.uint8).reshape(2, _SKETCH)
    return made.where("slot IS NULL").drop("slot", "n"), levels


class _Fresh:
    """Which of a task's nodes come for the first time; forgets all after a million."""

    def __init__(self):
        self.index = HashIndex(16)

    def __call__(self, nodes: np.ndarray) -> np.ndarray:
        if len(self.index.known) > 1 << 20:
            self.index = HashIndex(16)
        first = np.unique(nodes, return_index=True)[1]
        first = np.sort(first[self.index.find(nodes[first].view(_U)) < 0])
        self.index.add(nodes[first].view(_U))
        return first


def _token_rows(docs: DataFrame, settings: Settings, levels: np.ndarray, wanted: bytes | None) -> DataFrame:
    """node, n, tokens and parity bits: the prefix of each line's tokens, or all tokens of the wanted nodes.

    Lines that no other set can be similar to, those of fewer than three tokens, are left out. A
    node comes about once per task, so repeated lines are combined before the shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast((levels, wanted))

    def run(batches):
        levels, wanted = sent.value
        passes, fresh = Bitmap(wanted) if wanted is not None else None, _Fresh()
        for batch in batches:
            for _, words in _runs(batch):
                ids, row = _tokens(words, settings.shingle)
                values, starts = _token_sets(ids, row, words.rows, levels)
                sizes, nodes = np.diff(starts), _nodes(values, starts)
                at = np.flatnonzero((sizes >= 3) & (passes(nodes) if passes else True))
                at = at[fresh(nodes[at])]
                n = sizes[at]
                take = n if passes else n + (-n * settings.percent) // 100 + 1  # n - ceil(n * share) + 1
                ends = np.cumsum(take)
                flat = values[np.repeat(starts[at] - (ends - take), take) + np.arange(int(take.sum()))]
                edges = np.concatenate([[0], ends]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64)))
                columns = [pa.array(nodes[at]), pa.array(n), tokens]
                if not passes:
                    columns += [pa.array(c) for c in parities(values, starts, at, len(_BITS))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["node", "n", "tokens", *(_BITS if wanted is None else ())]
    kinds = ["bigint", "bigint", "array<bigint>", *(["bigint"] * 4 if wanted is None else ())]
    made = docs.select("__text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return made.groupBy("node").agg(*(F.first(n).alias(n) for n in names[1:]))


def _proved(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.where(100 * both >= settings.percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def similar_lines(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line: ``key``, ``text_hash``, ``line``, ``n_tokens``, ``class_id``, ``n_links``, ``first_key``,
    ``first_line``, ``removed`` and ``repeats``.

    class_id: the same for lines that links lead between, directly or over others; null for lines
    without words. n_links: how many other lines of the table, copies and lines of repeated rows
    included, are linked with the line directly. first_key and first_line: the first line, by key,
    hash of the text and number, of the class. removed: the line is not that one. repeats: an earlier
    line is linked with it directly; dedup_lines goes by this. Lines are the parts between newlines; a
    line without words has no links and is its own first. Null texts are one empty line. Rows of equal
    key and text are one document here and lose the same lines. A null key comes first.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("__text"))
    lines, levels = _lines(docs, settings)
    prefixes = landed(_token_rows(docs, settings, levels, None), "prefixes")
    # Tokens that stand in one prefix only lead nowhere; a filter of fixed size leaves most of them out.
    repeated = prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("size"))
    some = bitmap(repeated.where("size > 1").select(F.col("token").alias("x")), 1 << 26)
    sent = docs.sparkSession.sparkContext.broadcast(some)

    def index(batches):
        passes = Bitmap(sent.value)
        for batch in batches:
            tokens = batch.column(2)
            edges = tokens.offsets.to_numpy().astype(np.int64)
            flat = tokens.values.to_numpy()[edges[0] : edges[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            at = np.flatnonzero(passes(flat))
            place = at + edges[0] - edges[owner[at]]
            rows = pa.array(owner[at])
            # The token before, null for the first one: a pair that shares it too was met there.
            first = np.ones(len(at), bool)
            first[1:] = owner[at[1:]] != owner[at[:-1]]
            before = pa.array(np.concatenate([flat[at][:1], flat[at][:-1]]), mask=first)
            columns = [pa.array(flat[at]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), before]
            columns += [batch.column(i).take(rows) for i in range(3, 3 + len(_BITS))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "place", "before", *_BITS])

    kinds = "token bigint, node bigint, n bigint, place bigint, before bigint, "
    kinds += ", ".join(f"{c} bigint" for c in _BITS)
    shared = landed(prefixes.select("node", "n", "tokens", *_BITS).mapInArrow(index, kinds), "shared-tokens")

    def alike(n, m):
        return 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)

    def close(left: str, right: str):
        """Whether two sets' parity bits allow the similarity; it never rules out a pair that has it."""
        both = F.col(f"{left}.n") + F.col(f"{right}.n")
        return (100 + settings.percent) * differ(left, right, _BITS) <= (100 - settings.percent) * both

    x, y = shared.alias("x"), shared.alias("y")
    left = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
    left &= F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    left &= alike(F.col("x.n"), F.col("y.n"))
    behind = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))  # the shared one included
    left &= (100 + settings.percent) * behind >= settings.percent * (F.col("x.n") + F.col("y.n"))
    left &= close("x", "y")
    pairs = landed(x.join(y, left).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "line-pairs")
    # Full sets are only made of nodes that stand in a pair.
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = bitmap(nodes.select(F.col("node").alias("x")), 1 << 26)
    sets = landed(_token_rows(docs, settings, levels, wanted), "line-sets")
    links = landed(_proved(pairs, sets, settings), "line-links")
    groups = landed(components(links), "line-components")
    place = F.struct("key", "text_hash", "line")
    own = lines.where("node <> 0").groupBy("node").agg(F.min(place).alias("own"), F.count("*").alias("copies"))
    # Lines without copies or links keep the defaults below, so most nodes go no further.
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("met", F.lit(True))
    own = landed(own.join(ends, "node", "left").where("copies > 1 OR met").drop("met"), "line-nodes")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionAll(links.select("b", "a"))
    others = own.select(F.col("node").alias("other"), F.col("own").alias("theirs"), F.col("copies").alias("more"))
    near = both.join(others, "other").groupBy("node").agg(F.min("theirs").alias("theirs"), F.sum("more").alias("more"))
    linked = own.join(near, "node", "left").join(groups, "node", "left").select(
        "node", "own",
        F.coalesce("component", "node").alias("class"),
        (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.least("own", "theirs").alias("nearest"),
    )
    linked = landed(linked.where("n_links > 0"), "line-classes")
    firsts = linked.groupBy("class").agg(F.min("own").alias("first"))
    linked = linked.join(firsts, "class").select("node", "class", "n_links", "first", "nearest")
    found = lines.join(linked, "node", "left").withColumn("first", F.coalesce("first", place))
    return found.select(
        F.col("key").alias(key), "text_hash", "line", "n_tokens",
        F.when(F.col("node") != 0, F.coalesce("class", "node")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("first.key").alias("first_key"), F.col("first.line").alias("first_line"),
        (F.col("first") != place).alias("removed"),
        F.coalesce(F.col("nearest") < place, F.lit(False)).alias("repeats"),
    )


def dedup_lines(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that repeat an earlier one; all other columns as they were.

    Documents that had words and lost them all are left out; texts that lose no line stay as they
    are, null ones too.
    """
    found = similar_lines(docs, settings, key, text).where("repeats")
    gone = found.groupBy(F.col(f"`{key}`").alias("key"), "text_hash").agg(F.collect_set("line").alias("lines"))
    rows = packed(docs, key, text).alias("d").join(gone.alias("x"), same_row("d", "x"), "left")
    rows = rows.select("row.*", F.col("x.lines").alias("__lines_to_remove"))
    columns = docs.columns
    at = columns.index(text)

    def run(batches):
        for batch in (some for whole in batches for some in small(whole, columns[at])):
            lost = batch.column(len(columns)).to_pylist()
            batch = batch.select(range(len(columns)))
            if not any(lost):
                yield batch
                continue
            kept, out = [], []
            for i, (body, numbers) in enumerate(zip(batch.column(at).to_pylist(), lost, strict=True)):
                if numbers:
                    drop = set(numbers)
                    body = "\n".join(line for j, line in enumerate(body.split("\n")) if j not in drop)
                    if not body.strip(" \t\n\x0b\f\r"):
                        continue
                kept.append(i)
                out.append(body)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield rows.set_column(at, columns[at], pa.array(out, batch.column(at).type))

    return rows.mapInArrow(run, docs.schema)
