"""Near-duplicate documents: MinHash candidates, sequential Bayesian verification, exact proof.

Texts of one shingle set are one node. Bands of the signature bring nodes into buckets. Candidates
are compared a batch of hashes at a time; after each batch the posterior of the similarity, given
how many hashes agreed, tells whether the pair may still reach the threshold, and pairs whose chance
falls below the chosen miss probability are dropped. Survivors are proved on their full sets.

A bucket of n copies is not expanded into pairs: its members are first compared with one of them
only, components are formed, and later rounds compare only what is still in different ones. There,
1,024 parity bits of each set first rule out pairs that differ in too many shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small
from signalspark.llm.components import Bitmap, bitmap, components
from signalspark.llm.kernel import BLOCK, Words, blocks, differ, mix, parities, utf8
from signalspark.llm.shared import landed, packed, same_row

_U = np.uint64
_BITS = tuple(f"p{i}" for i in range(16))


@dataclass(frozen=True)
class Settings:
    """percent: least similarity in percent; shingle: words in a shingle; bands of rows hashes each;
    batch: hashes compared at a time; miss: chance of dropping a pair that reaches the threshold."""

    percent: int = 75
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    draw = random.integers(0, 1 << 63, (2, n), dtype=np.int64).astype(_U)
    return draw[0] * _U(2) + _U(1), draw[1]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a run of texts one after another, and where each begins."""
    words = Words(raw, offsets)
    hashes, row = words.shingles(k)
    edges = np.searchsorted(row, np.arange(words.rows + 1)).tolist()
    sets = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else hashes[:0]), starts


def fingerprints(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set; equal sets have equal numbers. 0 for empty sets."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(values ^ _U(0x5851F42D4C957F2D)))])
    size = np.diff(starts).astype(_U)
    return np.where(size > 0, mix(sums[starts[1:]] - sums[starts[:-1]] + size), _U(0)).view(np.int64)


def _runs(batch):
    for some in small(batch):
        raw, offsets = utf8(some.column("__text"))
        for a, b in blocks(np.diff(offsets), BLOCK):
            yield some.slice(a, b - a), raw, offsets[a : b + 1]


def _features(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, text_hash, n_shingles, node (fingerprint of the set), signature and parity bits of every row."""
    a, b = _permutations(settings.hashes)

    def run(batches):
        for batch in batches:
            for some, raw, offsets in _runs(batch):
                values, starts = shingle_sets(raw, offsets, settings.shingle)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                signature = np.zeros((len(sizes), settings.hashes), np.uint32)
                if len(full):
                    for i in range(settings.hashes):
                        least = np.minimum.reduceat(values * a[i] + b[i], starts[:-1][full])
                        signature[full, i] = (least >> _U(32)).astype(np.uint32)
                rows = [s.tobytes() if n else None for s, n in zip(signature, sizes.tolist(), strict=True)]
                made = [pa.array(sizes), pa.array(fingerprints(values, starts)), pa.array(rows, pa.binary())]
                for part in parities(values, starts, full, len(_BITS)):
                    column = np.zeros(len(sizes), np.int64)
                    column[full] = part
                    made.append(pa.array(column))
                names = ["key", "text_hash", "n_shingles", "node", "signature", *_BITS]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], names)

    kind = docs.schema["key"].dataType.simpleString()
    made = f"key {kind}, text_hash bigint, n_shingles bigint, node bigint, signature binary"
    return docs.mapInArrow(run, ", ".join([made, *(f"{name} bigint" for name in _BITS)]))


def _bands(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(band, node, n): one row for each band of each node."""

    def run(batches):
        weights = _permutations(settings.rows)[0]
        for batch in batches:
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
                parts = flat.reshape(-1, settings.bands, settings.rows).astype(_U)
                keys = mix((mix(parts) * weights).sum(2, dtype=_U) + np.arange(settings.bands, dtype=_U))
                copies = np.repeat(np.arange(batch.num_rows), settings.bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(copies), batch.column(1).take(copies)],
                    ["band", "node", "n"],
                )

    return nodes.select("node", "n", "signature").mapInArrow(run, "band bigint, node bigint, n bigint")


def least_matches(settings: Settings) -> np.ndarray:
    """For each batch, the fewest agreeing hashes so far with which a pair goes on.

    The posterior of the similarity s after m of n is s^m (1 - s)^(n - m) with an even prior; a pair
    is dropped when its mass at the threshold and above is below the miss probability.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    high = s >= settings.percent / 100
    out = []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        mass = np.exp(log - log.max(1, keepdims=True))
        chance = mass[:, high].sum(1) / mass.sum(1)
        out.append(int(np.searchsorted(chance, settings.miss)))
    return np.array(out)


def _plausible(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that no batch of hashes rules out."""
    least = least_matches(settings)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in batch.columns[2:]
            )
            alive, agreed = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, need in enumerate(least):
                part = slice(step * settings.batch, (step + 1) * settings.batch)
                agreed[alive] += (left[alive, part] == right[alive, part]).sum(1)
                alive = alive[agreed[alive] >= need]
            yield batch.select([0, 1]).take(pa.array(alive))

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles) of wanted nodes (node, rep), from the one row that stands for each."""
    kind = docs.schema["key"].dataType.simpleString()
    some = bitmap(wanted.select(F.col("node").alias("x")))
    sent = docs.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        passes = Bitmap(sent.value)
        for batch in batches:
            for part, raw, offsets in _runs(batch):
                values, starts = shingle_sets(raw, offsets, settings.shingle)
                nodes = fingerprints(values, starts)
                at = np.flatnonzero(passes(nodes) & (np.diff(starts) > 0))
                sets = [values[starts[i] : starts[i + 1]].view(np.int64) for i in at.tolist()]
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                rows = part.select([0, 1]).take(pa.array(at, pa.int64())).columns
                sets = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))
                names = ["key", "text_hash", "node", "shingles"]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(nodes[at]), sets], names)

    rows = docs.mapInArrow(run, f"key {kind}, text_hash bigint, node bigint, shingles array<bigint>").alias("s")
    match = (F.col("s.node") == F.col("w.node")) & (F.col("s.text_hash") == F.col("w.rep.text_hash"))
    match &= F.col("s.key").eqNullSafe(F.col("w.rep.key"))
    return rows.join(wanted.alias("w"), match).select("s.node", "s.shingles").dropDuplicates(["node"])


def _proved(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = landed(_plausible(pairs, nodes, settings), "plausible-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = landed(ends.join(nodes.select("node", "rep"), "node"), "wanted-sets")
    sets = landed(_sets(docs, wanted, settings), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.where(100 * both >= settings.percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _place():
    """Orders rows by key, a null one last, then by the hash of the text."""
    return F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_hash").alias("text_hash"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id``, the smallest key reachable over links, and ``kept``.

    Texts are linked when their shingle sets have at least the settings' similarity; a text of fewer
    words than a shingle has one shingle of all its words; null and empty texts have none and are
    linked with nothing. kept: key = component_id; rows of equal key are kept or dropped together. A
    null key is larger than any other, and is kept where a component has no other key.
    """
    found = _groups(docs, key, text, settings)
    same = F.col("key").eqNullSafe(F.col("first.key"))
    return found.select(F.col("key").alias(key), "n_shingles", F.col("first.key").alias("component_id"), same.alias("kept"))


def _groups(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """Per row: key, text_hash, n_shingles and the first row of its component, itself included."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("__text"))
    rows = landed(_features(docs, settings), "signatures")
    full = rows.where("n_shingles > 0")
    reps = full.groupBy("node").agg(F.min(_place()).alias("rep"))
    nodes = full.select("node", F.col("n_shingles").alias("n"), "signature", *_BITS).dropDuplicates(["node"])
    nodes = landed(nodes.join(reps, "node"), "nodes")
    bands = _bands(nodes, settings)
    picked = F.struct(F.xxhash64("node", "band").alias("h"), "node", "n")  # another one in every band
    heads = bands.groupBy("band").agg(F.min(picked).alias("head"), F.count("*").alias("size"))
    shared = landed(bands.join(heads.where("size > 1").select("band", "head"), "band"), "shared-bands")

    def alike(n, m):
        return (100 * F.least(n, m) >= settings.percent * F.greatest(n, m))

    # Every node against one node of each of its buckets: first the smallest of these, then those that
    # are still in another component.
    stars = shared.where((F.col("node") != F.col("head.node")) & alike(F.col("n"), F.col("head.n")))
    ends = F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b")
    stars = landed(stars.select(*ends).distinct(), "stars")
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = landed(_proved(first, docs, nodes, settings), "links-1")
    groups = landed(components(links), "components-1")
    rest = _apart(stars.join(first, ["a", "b"], "left_anti"), groups)
    links = links.unionAll(landed(_proved(rest, docs, nodes, settings), "links-2"))
    groups = landed(components(links), "components-2")
    # Members of a bucket in different components that were not compared yet.
    own = F.coalesce("component", "node")
    placed = shared.join(groups, "node", "left").select("band", "node", "n", own.alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    placed = placed.join(mixed.select("band"), "band").join(nodes.select("node", *_BITS), "node")
    x, y = placed.alias("x"), placed.alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node"))
    apart &= (F.col("x.component") != F.col("y.component")) & alike(F.col("x.n"), F.col("y.n"))
    # Sets that differ in more members than the threshold allows differ in parity bits too.
    both = F.col("x.n") + F.col("y.n")
    apart &= (100 + settings.percent) * differ("x", "y", _BITS) <= (100 - settings.percent) * both
    left = x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    left = landed(left.join(stars, ["a", "b"], "left_anti"), "left-pairs")
    if not left.isEmpty():
        links = links.unionAll(landed(_proved(left, docs, nodes, settings), "links-3"))
        groups = landed(components(links), "components-3")
    smallest = groups.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = groups.join(smallest, "component").select("node", "least")
    own = reps.join(of_node, "node", "left").select("node", F.coalesce("least", "rep").alias("least"))
    found = rows.drop("signature", *_BITS).join(own, "node", "left")
    first = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(_place())
    return found.select("key", "text_hash", "n_shingles", first.alias("first"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One document of each group of near copies, that of the smallest key; all columns.

    Of rows with equal key and text one stays; documents with null or empty texts all stay.
    """
    found = landed(_groups(docs, key, text, settings).where("n_shingles > 0"), "groups")
    again = found.groupBy("key", "text_hash").agg(F.count("*").alias("n"), F.first("first").alias("first"))
    last = F.col("first") == _place()
    # Rows that go, and rows of which one stays.
    gone = again.where(~last).select("key", "text_hash")
    copies = again.where(last & (F.col("n") > 1)).select("key", "text_hash")
    rows = packed(docs, key, text).alias("d")
    single = rows.join(gone.unionAll(copies).alias("x"), same_row("d", "x"), "left_anti")
    one = rows.join(copies.alias("x"), same_row("d", "x"), "left_semi").dropDuplicates(["key", "text_hash"])
    return single.unionAll(one).select("row.*")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    left = groups.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    right = groups.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    rows = pairs.join(left, "a", "left").join(right, "b", "left")
    return rows.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
