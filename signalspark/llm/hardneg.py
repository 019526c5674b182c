"""Hard negatives by a GNAT-style multiway hyperplane tree with exact leaves.

Every node of the tree has some split points; a row goes to the nearest one, and for each pair of split
point and sibling subtree the least and greatest distance is stored. Scores are inner products: with
one more coordinate, which brings all rows to the same length and is 0 for the asker, the rows whose
score lies in a window are those in an annulus around the asker. A sibling goes when its range around
any split point can't meet the annulus, and so does a block of a leaf by its own ranges. What is left
is scored in integers, so the tree decides only what need not be looked at.

The tree is fitted on a bounded sample; all rows are sent down it. A leaf is cut into blocks by label and
distance, so a leaf of many equal rows is many blocks. Tasks hold a bounded number of askers at a time and
read the blocks as they lie: a look-up moves no rows, and each row is multiplied with those askers only
that may want it. The best few that a task has met of an asker bound what it looks for in further blocks;
the best of a sixteenth of all blocks bound what is looked for in the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.shared import batches_of, landed

#: Rounding of a distance, as a share of the lengths it comes from; annuli are widened by it.
_SLACK = 1e-6

#: Beyond all scores, and beyond all keys.
_FAR, _LAST = 1 << 62, np.iinfo(np.int64).max

#: Found rows that a task sorts at once, or keeps; rows that a part of a block of several labels has at least.
_FOUND, _PART = 1_000_000, 128

#: One block in so many is looked into first.
_FIRST = 16


@dataclass(frozen=True)
class Settings:
    """scale: components become floor(scale * x). positives and negatives: how many of each. low: least
    score of a negative in percent of the positive's. fanout: split points of a node; leaf_rows: rows
    that a leaf should have; levels: of the tree at most; sample: rows that it is fitted on at most;
    block: rows of a block; askers: anchors that are multiplied with a full block at once; held: bytes of
    the vectors of the anchors that a task holds."""

    scale: float = 256.0
    positives: int = 5
    negatives: int = 5
    low: int = 80
    fanout: int = 8
    leaf_rows: int = 8192
    levels: int = 4
    sample: int = 16384
    block: int = 1024
    askers: int = 256
    held: int = 32 << 20


def _floored(batches, scale: float) -> Iterator[pa.RecordBatch]:
    """key, label and x become key, label and v; rows with a null or non-finite component go."""
    for batch in batches:
        column = batch.column(2)
        edges = column.offsets.to_numpy().astype(np.int64)
        x = column.values[edges[0] : edges[-1]].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # NaN for null
        whole = np.ones(len(column), bool)
        whole[np.searchsorted(edges, np.flatnonzero(~np.isfinite(x)) + edges[0], "right") - 1] = False
        with np.errstate(all="ignore"):
            v = np.floor(np.where(np.isfinite(x), x, 0) * scale)
        v = pa.array(np.clip(v, -(2.0**62), 2.0**62).astype(np.int64))  # so large ones raise an error in any case
        v = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], ["key", "label", "v"]).filter(pa.array(whole))


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """key, label and v become key, label, size and v: components of so many bytes, as few as a batch needs."""
    for batch in batches:
        column = batch.column(2)
        edges = column.offsets.to_numpy().astype(np.int64)
        v = column.values.to_numpy()[edges[0] : edges[-1]]
        v = v.astype(_small(int(np.abs(v).max(initial=0))))
        columns = [batch.column(0), batch.column(1), pa.array(np.full(len(column), v.itemsize, np.int32)), _binary(v, edges - edges[0])]
        yield pa.RecordBatch.from_arrays(columns, ["key", "label", "size", "v"])


def quantised(rows: DataFrame, settings: Settings, key: str, label: str, vector: str) -> DataFrame:
    """key, label, size, v: one row for each key, the least label and vector of its rows; others take no part."""
    kind, lists = rows.select(F.col(f"`{vector}`")).dtypes[0][1], "key bigint, label bigint, v array<bigint>"
    plain = kind in [f"array<{k}>" for k in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    x = F.col(f"`{vector}`") if plain else F.col(f"`{vector}`").cast("array<double>")
    rows = rows.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{label}`").cast("bigint").alias("label"), x.alias("x"))
    rows, scale, packed = rows.where("key IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"), settings.scale, _KEPT

    def alone(some):
        return some.mapInArrow(lambda batches: _packed(_floored(batches, scale)), packed)

    again = landed(rows.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
    if again.isEmpty():  # vectors need not be sorted by key
        return alone(rows)
    several = rows.join(again, "key", "left_semi").mapInArrow(lambda batches: _floored(batches, scale), lists)
    least = several.groupBy("key").agg(F.min(F.struct("label", "v")).alias("one")).select("key", "one.label", "one.v")
    return alone(rows.join(again, "key", "left_anti")).union(least.mapInArrow(_packed, packed))


_KEPT = "key bigint, label bigint, size int, v binary"


def _vectors(sizes: pa.Array, column: pa.Array, width: int | None = None) -> np.ndarray:
    """What ``_packed`` has packed, as rows of a matrix; shorter ones end in zeros."""
    sizes = sizes.to_numpy()
    counts = pc.binary_length(column).to_numpy() // sizes
    out = np.zeros((len(sizes), counts.max(initial=0) if width is None else width), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        flat = np.frombuffer(b"".join((column if len(at) == len(sizes) else column.take(pa.array(at))).to_pylist()), f"i{size}")
        ends = np.cumsum(counts[at])
        if len(flat) == len(at) * out.shape[1]:
            out[at] = flat.reshape(len(at), out.shape[1])
        else:
            out[np.repeat(at, counts[at]), np.arange(len(flat)) - np.repeat(ends - counts[at], counts[at])] = flat
    return out


def _small(most: int) -> np.dtype:
    """The smallest integers that hold all components up to so much."""
    return np.dtype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max))


def _binary(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers between such edges as one binary value each."""
    offsets, data = np.ascontiguousarray(edges * flat.itemsize, np.int32), np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """Binary values as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def exact_kind(top: int) -> type:
    """Numbers in which inner products of integer rows are exact whose squared lengths lie below top: no sum
    of some of the products is larger. Sums stay below 2**56 (``_measure`` sees to it)."""
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


@dataclass
class Node:
    """points: split points with their last coordinate; children: nodes or leaf numbers; ranges: for each
    child the least and greatest distance of its rows to all points, None for a child without rows."""

    points: np.ndarray
    children: list
    ranges: list


@dataclass
class Tree:
    """width: components of a row; top: above all squared lengths; paths: the nodes and children on the way
    to each leaf."""

    root: Node | int
    width: int
    top: int
    paths: list[list[tuple[Node, int]]]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows of equal length: the last coordinate makes up what each lacks."""
        rest = self.top - np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
        return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(rest, 0))])


def _distances(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", points, points)[None] - 2 * (a @ points.T)
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, n_rows: int, top: int, settings: Settings) -> Tree:
    """A tree for so many rows from a sample of them. Split points are drawn far from each other."""
    tree = Tree(0, sample.shape[1], top, [])
    depth = 0
    while depth < settings.levels and n_rows > settings.leaf_rows * settings.fanout**depth:
        depth += 1

    def grow(x: np.ndarray, level: int, path: list) -> Node | int:
        if level < depth and len(x) >= 2 * settings.fanout:
            far, picked = _distances(x, x[:1])[:, 0], [0]
            while len(picked) < settings.fanout and far.max() > 1:
                picked.append(int(far.argmax()))
                far = np.minimum(far, _distances(x, x[picked[-1] :][:1])[:, 0])
            if len(picked) > 1:
                node = Node(x[picked], [], [None] * len(picked))
                near = _distances(x, node.points).argmin(1)
                for i in range(len(picked)):
                    node.children.append(grow(x[near == i], level + 1, [*path, (node, i)]))
                return node
        tree.paths.append(path)
        return len(tree.paths) - 1

    tree.root = grow(tree.lifted(sample), 0, [])
    return tree


def placed(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each row and its distance to the leaf's own split point."""
    rows = tree.lifted(x)
    leaf, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    todo = [(tree.root, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, Node):
            leaf[at] = node
        elif len(at):
            distance = _distances(rows[at], node.points)
            child = distance.argmin(1)
            near[at] = distance[np.arange(len(at)), child]
            todo += [(node.children[i], at[child == i]) for i in range(len(node.children))]
    return leaf, near


def _spans(tree: Tree, leaf: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of some rows to all split points on the way to their leaf."""
    path = tree.paths[leaf]
    if not path:
        return np.empty(0), np.empty(0)
    distance = np.concatenate([_distances(rows, node.points) for node, _ in path], 1)
    return distance.min(0), distance.max(0)


def _meets(distance, low, high, inner, outer) -> np.ndarray:
    """Whether a range of distances around each split point can meet the annulus around the asker, for
    all points. distance: askers x points; low and high: points; inner and outer: askers."""
    least = np.maximum(np.maximum(distance - high, low - distance), 0).max(1, initial=0)
    most = (distance + high).min(1, initial=np.inf)
    return (least <= outer) & (most >= inner)


def annuli(tree: Tree, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer distance of rows whose score lies between low and high, widened by rounding. square:
    squared lengths of the askers."""
    lengths = square + tree.top
    inner, outer = lengths - 2.0 * high, lengths - 2.0 * low
    slack = _SLACK * (1 + np.sqrt(lengths))
    return np.sqrt(np.maximum(inner, 0)) - slack, np.sqrt(np.maximum(outer, 0)) + slack


class Search:
    """Askers on their way through the tree: which of them a leaf or block may have rows for."""

    def __init__(self, tree: Tree, asked: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.tree, self.asked, self.near = tree, asked, {}
        self.square = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x, x) for x in map(np.float64, self._parts(asked)))])
        self.narrow(low, high)

    @staticmethod
    def _parts(x: np.ndarray) -> list[np.ndarray]:
        return [x[i : i + 8192] for i in range(0, len(x), 8192)]

    def narrow(self, low: np.ndarray, high: np.ndarray) -> None:
        """Only scores from low to high are asked for."""
        self.inner, self.outer = annuli(self.tree, self.square, low, high)

    def _distance(self, node: Node) -> np.ndarray:
        if id(node) not in self.near:
            asking = (np.column_stack([x.astype(np.float64), np.zeros(len(x))]) for x in self._parts(self.asked))
            self.near[id(node)] = np.concatenate([_distances(x, node.points).astype(np.float32) for x in asking])
        return self.near[id(node)]

    def _left(self, at: np.ndarray, nodes: list[Node], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        def meets(some):
            distance = np.concatenate([self._distance(node)[some] for node in nodes], 1)
            return _meets(distance, low, high, self.inner[some], self.outer[some])

        few = at[:: max(1, len(at) // 512)]
        if not nodes or not len(at) or len(few) < len(at) and meets(few).mean() > 0.95:  # too few would go
            return at
        return np.concatenate([some[meets(some)] for some in self._parts(at)])

    def leaf(self, leaf: int, at: np.ndarray) -> np.ndarray:
        """Those of the askers ``at`` that must look into a leaf, and maybe a few more."""
        path = self.tree.paths[leaf]
        self.near = {id(node): self.near[id(node)] for node, _ in path if id(node) in self.near}
        for node, child in path:
            span = node.ranges[child]
            at = at[:0] if span is None else self._left(at, [node], *span)
        return at

    def block(self, leaf: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The same for a block with its ranges."""
        return self._left(at, [node for node, _ in self.tree.paths[leaf]], low, high)


def leaves_of(tree: Tree, askers: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf that some asker must look into, with the askers' numbers."""
    search = Search(tree, askers, low, high)
    for leaf in range(len(tree.paths)):
        at = search.leaf(leaf, np.arange(len(askers)))
        if len(at):
            yield leaf, at


def with_ranges(tree: Tree, spans: list[tuple[int, np.ndarray, np.ndarray]]) -> Tree:
    """spans: per leaf with rows, the least and greatest distances to the points on its way."""
    for leaf, low, high in spans:
        at = 0
        for node, child in tree.paths[leaf]:
            part = slice(at, at + len(node.points))
            at, old = part.stop, node.ranges[child]
            here = low[part], high[part]
            node.ranges[child] = here if old is None else (np.minimum(old[0], here[0]), np.maximum(old[1], here[1]))
    return tree


@dataclass
class Index:
    """tree: with its ranges; kind: integers that the rows are kept in; blocks: leaf, keys, labels, rows and
    ranges of every block, in order of label and key."""

    tree: Tree
    kind: np.dtype
    blocks: DataFrame


def _measure(rows: DataFrame) -> tuple[int, int, int, int]:
    """Number of rows, length of the longest vector, above the greatest squared length and largest component."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(*batch.columns)
                square = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)).max()
                some = [len(x)], [x.shape[1]], [float(square)], [int(np.abs(x).max(initial=0))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in some], ["n", "width", "top", "most"])

    measured = rows.select("size", "v").mapInArrow(run, "n bigint, width bigint, top double, most bigint")
    n, width, top, most = measured.agg(F.sum("n"), F.max("width"), F.max("top"), F.max("most")).first()
    if n and top >= 1 << 55:
        raise ValueError("components are too large for integer scores of 64 bits; choose a smaller scale")
    return n or 0, width or 0, int(top or 0) + 1, most or 0


_PLACED = "leaf bigint, near double, key bigint, label bigint, v binary"
_BLOCK = "leaf bigint, keys binary, labels binary, rows binary, low array<double>, high array<double>"


def _names(kinds: str) -> list[str]:
    return [k.split()[0] for k in kinds.split(", ")]


def _placed(rows: DataFrame, tree: Tree, kind: np.dtype) -> DataFrame:
    """rows as ``quantised`` gives them, with their leaves and distances."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        tree = sent.value
        for batch in batches:
            x = _vectors(batch.column(2), batch.column(3), tree.width)
            leaf, near = placed(tree, x)
            v = _binary(x.astype(kind).ravel(), np.arange(len(x) + 1) * tree.width)
            columns = [pa.array(leaf), pa.array(near), batch.column(0), batch.column(1), v]
            yield pa.RecordBatch.from_arrays(columns, _names(_PLACED))

    return rows.select("key", "label", "size", "v").mapInArrow(run, _PLACED)


def build(rows: DataFrame, settings: Settings) -> Index:
    """The index of rows as ``quantised`` gives them."""
    spark = rows.sparkSession
    n, width, top, most = _measure(rows)
    kind, mixed = _small(most), F.xxhash64("key")
    share = (4 * settings.sample + 64) / max(n, 1)  # more than are needed, else every task gives so many
    some = rows if share >= 1 else rows.where(mixed < F.lit(int(share * 2**64) - (1 << 63)))
    some = some.orderBy(mixed, "key").limit(settings.sample).select("size", "v").toArrow()  # of bounded size
    sample = _vectors(some.column(0), some.column(1), width)
    tree = fit(sample, n, top, settings)
    sent = spark.sparkContext.broadcast(tree)
    order = ["leaf", "label", "near", "key"]
    sorted_rows = _placed(rows, tree, kind).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        tree, held, last = sent.value, [], None

        def block(parts, leaf):
            keys, labels, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
            low, high = _spans(tree, leaf, tree.lifted(x))
            at = np.lexsort((keys, labels))
            columns = [
                pa.array([leaf]), pa.array([keys[at].tobytes()]), pa.array([labels[at].tobytes()]), pa.array([x[at].tobytes()]),
                pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays(columns, _names(_BLOCK))

        for batch in batches:
            leaves, keys, labels = (batch.column(i).to_numpy() for i in (0, 2, 3))
            x = _unpacked(batch.column(4), kind, tree.width)
            edges = [0, *(np.flatnonzero(np.diff(leaves) | np.diff(labels)) + 1).tolist(), len(leaves)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    here, size = (int(leaves[a]), int(labels[a])), sum(len(p[0]) for p in held)
                    full = settings.block if here == last else settings.block // 2  # most blocks have one label
                    if held and (here[0] != last[0] or size >= full):
                        yield block(held, last[0])
                        held, size = [], 0
                    last, end = here, min(b, a + settings.block - size)
                    held.append((keys[a:end], labels[a:end], x[a:end]))
                    a = end
        if held:
            yield block(held, last[0])

    small = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "10"}  # for many tasks
    blocks = landed(sorted_rows.mapInArrow(cut, _BLOCK), "vector-blocks", options=small)
    spans = blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    spans = spans.groupBy("leaf", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    spans = spans.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("x"))
    found = [  # one row for each leaf: fanout ** levels at most
        (r.leaf, np.array([s.low for s in r.x]), np.array([s.high for s in r.x])) for r in spans.collect()
    ]
    return Index(with_ranges(tree, found), kind, blocks)


@dataclass
class Askers:
    """Some anchors in order of label and key, with their leaves and their distances there."""

    keys: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    leaf: np.ndarray
    near: np.ndarray


@dataclass
class Slots:
    """What askers look for, askers x slots: the best ``many`` rows with a score of at most upper. Rows of a
    score below lower, or of that score and a key above last, are not among them. Lower is above upper in a
    slot that takes none."""

    many: int
    upper: np.ndarray
    lower: np.ndarray
    last: np.ndarray


def ranks(slots: Slots, asker: np.ndarray, score: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each slot, the numbers and ranks of the rows that it takes, which come by asker, falling score and key."""
    new = np.flatnonzero(np.diff(asker, prepend=-1))
    first = np.repeat(new, np.diff(new, append=len(asker)))
    for slot in range(slots.upper.shape[1]):
        lower = slots.lower[asker, slot]
        ok = (score > lower) | ((score == lower) & (key <= slots.last[asker, slot]))
        ok &= (score <= slots.upper[asker, slot]) & (lower <= slots.upper[asker, slot])
        rank = np.cumsum(ok)
        rank -= (rank - ok)[first]
        at = np.flatnonzero(ok & (rank <= slots.many))
        yield slot, at, rank[at]


class Best:
    """The best rows met so far of each asker's slots. low and last: what a row must have to be among them in
    any slot, as in ``Slots``; high: the greatest score that a slot takes."""

    def __init__(self, slots: Slots, top: int):
        self.slots, self.top = replace(slots, lower=slots.lower.copy(), last=slots.last.copy()), top
        self.high = np.clip(slots.upper.max(1), -top, top)
        self.low, self.last = np.empty_like(self.high), np.empty_like(self.high)
        self._bound(np.arange(len(self.high)))
        self._clear()

    def _clear(self) -> None:
        self.kept, self.new, self.n = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def _bound(self, at: np.ndarray) -> None:
        lower = self.slots.lower[at]
        low = lower.min(1)
        self.last[at] = np.where(lower == low[:, None], self.slots.last[at], -1 - _LAST).max(1)
        self.low[at] = np.clip(low, -self.top, self.top + 1)

    def add(self, asker: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        self.new.append((asker.astype(np.int32), score.astype(np.int64), key))
        self.n += len(asker)

    def settle(self) -> None:
        """Keeps what a slot may take, and bounds each slot by the last of enough rows."""
        asker, score, key = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        self.new, self.n = [], 0
        order = np.lexsort((key, -score, asker))
        asker, score, key = asker[order], score[order], key[order]
        keep = np.zeros(len(asker), bool)
        for slot, at, rank in ranks(self.slots, asker, score, key):
            keep[at] = True
            at = at[rank == self.slots.many]
            self.slots.lower[asker[at], slot], self.slots.last[asker[at], slot] = score[at], key[at]
        self._bound(np.unique(asker))
        self.kept = asker[keep], score[keep], key[keep]

    def given(self) -> pa.RecordBatch:
        """What is kept; the bounds stay."""
        asker, score, key = self.kept
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (asker, key, score)], _names(_FOUNDS))


_FOUNDS = "asker int, other bigint, score bigint"
_BESTS = "asker int, slot int, rank int, other bigint, score bigint"


def _parts(labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a block in order of label: most of one label, none of them very small but the last."""
    cuts = [0]
    for at in (np.flatnonzero(np.diff(labels)) + 1).tolist():
        if at - cuts[-1] >= _PART:
            cuts.append(at)
    return zip(cuts, [*cuts[1:], len(labels)], strict=True)


def _top(ok: np.ndarray, score: np.ndarray, many: int) -> np.ndarray:
    """The best ``many`` of each row's cells that are ok; of equal ones the first."""
    if score.shape[1] <= many:
        return ok
    score = np.where(ok, score, -_FAR if score.dtype == np.int64 else -np.inf)
    least = np.partition(score, score.shape[1] - many, axis=1)[:, -many, None]
    over, same = score > least, ok & (score == least)
    return over | (same & (same.cumsum(1) <= many - over.sum(1, keepdims=True)))


def _looked_into(index: Index, tree, askers, slots, settings: Settings, blocks: DataFrame, negatives: bool, home: bool = False) -> DataFrame:
    """Rows of some blocks among which are the best of each slot there. tree, askers, slots: as sent to all
    tasks. home: only the blocks of an asker's leaf that it may lie in itself."""

    def run(batches):
        root, who, kind = tree.value, askers.value, exact_kind(tree.value.top)
        best, asked = Best(slots.value, root.top), who.x.astype(kind)
        search = Search(root, who.x, best.low, best.high)
        seeking, last, into = np.flatnonzero(best.low <= best.high), None, None
        space = np.empty(settings.askers * settings.block, kind)

        def at_home(leaf, labels, low, high):
            at = np.flatnonzero((who.leaf == leaf) & (who.labels >= labels[0]) & (who.labels <= labels[-1]))
            path = root.paths[leaf]
            if path:
                node, child = path[-1]
                least, most = (s[len(s) - len(node.points) + child] for s in (low, high))
                slack = _SLACK * (1 + root.top**0.5)
                at = at[(who.near[at] >= least - slack) & (who.near[at] <= most + slack)]
            return at

        def meet(at, keys, labels, x, mixed):
            """Askers and rows, which come by key; mixed: rows of several labels."""
            whole = at[-1] - at[0] == len(at) - 1
            score = space[: len(at) * len(keys)].reshape(len(at), len(keys))
            np.matmul(asked[at[0] : at[-1] + 1] if whole else asked[at], x.T, out=score)
            low = (best.low[at] + (best.last[at] < keys[0])).astype(kind)
            some = np.flatnonzero(score.max(1) >= low)
            if not len(some):
                return
            score, at = score[some], at[some]
            ok = (score >= low[some, None]) & (score <= best.high[at, None].astype(kind)) & (keys != who.keys[at, None])
            if mixed:
                ok &= (labels == who.labels[at, None]) != negatives
            many = best.slots.many
            if np.count_nonzero(ok) > 4 * many * len(at):
                few = np.zeros_like(ok)
                for slot in range(best.slots.upper.shape[1]):
                    lower, upper = (np.clip(s[at, slot, None], -root.top, root.top + 1).astype(kind) for s in (best.slots.lower, best.slots.upper))
                    few |= _top(ok & (score >= lower) & (score <= upper), score, many)
                ok = few
            i, j = np.nonzero(ok)
            best.add(at[i], score[i, j], keys[j])

        for batch in batches:
            for row in batch.to_pylist():
                leaf, keys, labels = row["leaf"], np.frombuffer(row["keys"], np.int64), np.frombuffer(row["labels"], np.int64)
                x = np.frombuffer(row["rows"], index_kind).reshape(len(keys), root.width)
                span = np.array(row["low"]), np.array(row["high"])
                if home:
                    block = at_home(leaf, labels, *span)
                else:
                    if leaf != last:
                        last, into = leaf, search.leaf(leaf, seeking)
                    block = search.block(leaf, into, *span)
                for a, b in _parts(labels):
                    mixed = labels[a] != labels[b - 1]
                    order = a + np.argsort(keys[a:b]) if mixed else slice(a, b)
                    part = keys[order], labels[order], x[order].astype(kind), mixed
                    start, end = (np.searchsorted(who.labels[block], labels[i], side) for i, side in ((a, "left"), (b - 1, "right")))
                    if not negatives:
                        asking = [block[start:end]]
                    else:
                        asking = [block] if mixed else [block[:start], block[end:]]
                    step = len(space) // (b - a)
                    for at in asking:
                        for i in range(0, len(at), step):
                            meet(at[i : i + step], *part)
                            if best.n > _FOUND:
                                best.settle()
                                search.narrow(best.low, best.high)
                                if len(best.kept[0]) > _FOUND:
                                    yield best.given()
        best.settle()
        yield best.given()

    index_kind = index.kind
    return blocks.mapInArrow(run, _FOUNDS)


def _bests(found: DataFrame, slots) -> DataFrame:
    """The best rows of each slot among those found."""

    def run(batches):
        best = Best(slots.value, _FAR)
        for batch in batches:
            best.add(*(batch.column(i).to_numpy() for i in (0, 2, 1)))
            if best.n > _FOUND:
                best.settle()
        best.settle()
        asker, score, key = best.kept
        for slot, at, rank in ranks(best.slots, asker, score, key):
            columns = asker[at], np.full(len(at), slot, np.int32), rank.astype(np.int32), key[at], score[at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _names(_BESTS))

    return found.repartition("asker").mapInArrow(run, _BESTS)


def _bounded(slots: Slots, sent, found: DataFrame) -> Slots:
    """The slots, bounded by the last of enough rows among those found."""
    last = _bests(found, sent).where(F.col("rank") == slots.many).toArrow()  # one row for a slot at most
    at = last["asker"].to_numpy(), last["slot"].to_numpy()
    slots = replace(slots, lower=slots.lower.copy(), last=slots.last.copy())
    slots.lower[at], slots.last[at] = last["score"].to_numpy(), last["other"].to_numpy()
    return slots


def _mined(asking: DataFrame, index: Index, tree, settings: Settings) -> DataFrame:
    """The hard negatives of so many anchors as a task can hold."""
    spark = asking.sparkSession
    rows = asking.toArrow()
    keys, labels, leaf, near = (rows[c].to_numpy() for c in ("key", "label", "leaf", "near"))
    order = np.lexsort((keys, labels))
    who = Askers(keys[order], labels[order], _unpacked(rows["v"], index.kind, index.tree.width)[order], leaf[order], near[order])
    sent, early = [spark.sparkContext.broadcast(who)], F.expr(f"pmod(xxhash64(keys), {_FIRST}) = 0")

    def tell(slots):
        sent.append(spark.sparkContext.broadcast(slots))
        return sent[-1]

    def look(slots, blocks, name, negatives=False, home=False):
        return landed(_looked_into(index, tree, sent[0], slots, settings, blocks, negatives, home), name)

    def everywhere(slots, negatives=False):
        first = look(tell(slots), index.blocks.where(early), "found-first", negatives)
        slots = _bounded(slots, sent[-1], first)
        return _bests(first.union(look(tell(slots), index.blocks.where(~early), "found", negatives)), sent[-1])

    shape = len(keys), settings.positives
    one = np.full((len(keys), 1), _FAR)
    slots = Slots(settings.positives, one, -one, np.full_like(one, _LAST))
    if len(index.tree.paths) > 1:  # the last of enough positives near an anchor is a bound for all others
        slots = _bounded(slots, tell(slots), look(sent[-1], index.blocks, "found-at-home", home=True))
    positives = everywhere(slots).toArrow()  # a few for each anchor
    at = positives["asker"].to_numpy(), positives["rank"].to_numpy() - 1
    others, upper = np.zeros(shape, np.int64), np.full(shape, -_FAR)
    others[at], upper[at] = positives["other"].to_numpy(), positives["score"].to_numpy()
    # A negative positive score has an empty window: 80 percent of it are more than it is.
    lower = np.where(upper >= 0, -(-settings.low * np.maximum(upper, 0) // 100), _FAR)
    found = everywhere(Slots(settings.negatives, upper, lower, np.full(shape, _LAST)), negatives=True)
    pairs = tell((who.keys, others, upper))

    def named(batches):
        keys, others, upper = pairs.value
        for batch in batches:
            asker, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [pa.array(keys[asker]), pa.array(others[asker, slot]), *batch.columns[2:4], pa.array(upper[asker, slot]), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, _names(_MINED))

    mined = landed(found.mapInArrow(named, _MINED), "hard-negatives")
    for one in sent:
        one.destroy()
    return mined


_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(
    rows: DataFrame, anchors, settings: Settings = Settings(), key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """Per anchor and positive, up to ``negatives`` hard negatives: ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    anchors: a condition on ``key`` (a column expression of a column named key). An anchor's positives are
    the best other rows of its label, its negatives for one of them the best rows of other labels whose
    score is at most the positive's and at least ``low`` percent of it. A score is the inner product of
    ``floor(scale * x)``; ties go to the smaller key. Rows with a null key, label or vector, or with a null
    or non-finite component, take no part; of rows with equal keys the one of the least label and
    vector counts; shorter vectors end in zeros, as empty ones do. Components whose squares sum to
    2**55 or more raise an error. Other columns are not looked at; an empty table gives no rows.
    """
    spark = rows.sparkSession
    with batches_of(spark, "8m"):
        rows = landed(quantised(rows, settings, key, label, vector), "vectors")
        index = build(rows, settings)
        asking = landed(_placed(rows.where(anchors), index.tree, index.kind), "anchors")
        size = asking.count() * max(1, index.tree.width) * index.kind.itemsize
        turns, tree = math.ceil(size / settings.held), spark.sparkContext.broadcast(index.tree)
        found = [  # each turn reads all blocks
            _mined(asking.where(F.expr(f"pmod(xxhash64(key), {turns}) = {turn}")), index, tree, settings) for turn in range(turns)
        ]
        tree.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], _MINED)
