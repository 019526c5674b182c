"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.llm import hardneg

KIND = "vec_id bigint, embedding array<double>, label int"


def brute(rows, settings):
    one = {}
    for key, x, label in rows:
        if key is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(settings.scale * c)) for c in x]
        one[key] = min(one.get(key, (label, v)), (label, v))
    out = set()
    for a, (label, v) in one.items():
        if a % 100:
            continue
        score = {k: sum(p * q for p, q in zip(v, w)) for k, (_, w) in one.items()}
        ranked = sorted((k for k in one if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in ranked if one[k][0] == label][: settings.positives]:
            negatives = [
                k for k in ranked
                if one[k][0] != label and settings.low * score[p] <= 100 * score[k] <= 100 * score[p]
            ]
            for i, k in enumerate(negatives[: settings.negatives]):
                out.add((a, p, i + 1, k, score[p], score[k]))
    return out


def vectors(seed, n, width=6, spread=0.4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, width))
    rows = []
    for i in range(n):
        x = centres[rnd.integers(5)] + spread * rnd.normal(size=width)
        rows.append((i * 4, (x * rnd.choice([0.2, 1.0, 3.0])).tolist(), int(rnd.integers(3))))
    return rows


def found(spark, rows, settings, kind=KIND):
    frame = spark.createDataFrame(rows, kind)
    return [tuple(r) for r in hardneg.mine(frame, F.col("key") % 100 == 0, settings).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


@pytest.mark.parametrize(
    "settings",
    [hardneg.Settings(), hardneg.Settings(leaf_rows=20, fanout=3, block=8, askers=2), hardneg.Settings(low=10, negatives=2, leaf_rows=50, block=16)],
)
def test_equals_brute_force(spark, settings):
    rows = vectors(1, 700) + [(None, [0.1] * 6, 1), (100_000, None, 1), (100_100, [0.1] * 6, None), (100_200, [0.1, None] * 3, 1)]
    rows += [(100_300, [float("nan")] * 6, 1), (100_400, [float("inf")] * 6, 2), (100_500, [], 1), (100_600, [0.5, 0.25], 0)]
    rows += [(7, [9.0] * 6, 2), (7, [8.0] * 6, 0)]
    got = found(spark, [(*r, "x", "y") for r in rows], settings, KIND + ", key string, leaf string")
    assert len(got) == len(set(got)) and set(got) == brute(rows, settings)


def test_equal_vectors_and_ties(spark):
    settings = hardneg.Settings(leaf_rows=30, fanout=4, block=16, askers=3)
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(300)] + [(i, x[:3], y) for i, x, y in vectors(2, 300, 3)[100:]]
    rows = list({r[0]: r for r in rows}.values())
    assert set(found(spark, rows, settings)) == brute(rows, settings)


def test_the_tree_leaves_out_most_rows_of_other_clusters():
    settings = hardneg.Settings(leaf_rows=100, fanout=5)
    rnd = np.random.default_rng(3)
    centres = 2000 * rnd.normal(size=(5, 8))
    x = np.floor(centres[rnd.integers(5, size=2000)] + 20 * rnd.normal(size=(2000, 8))).astype(np.int64)
    top = int((x * x).sum(1).max()) + 1
    tree = hardneg.fit(x[:500], len(x), top, settings)
    leaf, _ = hardneg.placed(tree, x)
    spans = [(n, *hardneg._spans(tree, n, tree.lifted(x[leaf == n]))) for n in np.unique(leaf).tolist()]
    hardneg.with_ranges(tree, spans)
    asker, scores = x[:1], x @ x[0]
    low = np.array([int(np.sort(scores)[-20])])
    visited = {n for n, _ in hardneg.leaves_of(tree, asker, low, np.array([1 << 62]))}
    assert set(leaf[scores >= low[0]].tolist()) <= visited and len(visited) < len(tree.paths) / 2


def test_empty_and_too_large(spark):
    assert found(spark, [], hardneg.Settings()) == []
    assert found(spark, [(0, None, 1)], hardneg.Settings()) == []
    with pytest.raises(ValueError):
        found(spark, [(0, [1e300], 1), (1, [1.0], 1)], hardneg.Settings())


def test_several_turns_repeated_keys_and_other_kinds(spark):
    settings = hardneg.Settings(scale=16.0, leaf_rows=40, fanout=3, block=16, askers=4, held=64)
    rows = [(k % 1300 // 2, [int(c * 4) for c in x], y) for k, x, y in vectors(5, 900)]
    rows += [(200, [1, 2], 0), (200, [1], 0), (300, [], 1), (400, [1, None], 1), (400, [3] * 6, 2), (500, None, 0), (500, [2] * 6, 0)]
    for kind in ("smallint", "decimal(9,2)", "float"):
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<int>, label int")
        frame = frame.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = [tuple(r) for r in hardneg.mine(frame, F.col("key") % 100 == 0, settings).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, settings)


def test_many_rows_above_and_between_the_positives(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0)]
    rows += [(10 + i, [0.4 + 0.001 * i, 0.1], 1 + i % 2) for i in range(900)]
    assert set(found(spark, rows, hardneg.Settings(positives=3, block=256, askers=3))) == brute(rows, hardneg.Settings(positives=3))


class Sent:
    def __init__(self, value):
        self.value = value


class Blocks(list):
    """Block rows that are looked into right here."""

    def mapInArrow(self, run, kinds):  # noqa: N802
        class Batch:
            to_pylist = lambda _: list(self)

        return [b for b in run(iter([Batch()]))]


def test_every_pair_is_multiplied_in_one_look_up_only(monkeypatch):
    """Positives among rows of an asker's label, negatives among the others; before, both among all rows."""
    rnd = np.random.default_rng(8)
    x, labels, keys = rnd.integers(-40, 40, (1200, 8)), np.repeat(np.arange(6), 200), np.arange(1200)
    top = int((x * x).sum(1).max()) + 1
    settings = hardneg.Settings(leaf_rows=10_000)
    tree = hardneg.fit(x, len(x), top, settings)
    blocks = Blocks(
        {"leaf": 0, "keys": keys[s].tobytes(), "labels": labels[s].tobytes(), "rows": x[s].astype(np.int8).tobytes(), "low": [], "high": []}
        for s in (slice(i, i + 200) for i in range(0, 1200, 200))
    )
    at = np.arange(0, 1200, 10)
    who = hardneg.Askers(keys[at], labels[at], x[at].astype(np.int8), np.zeros(120, np.int64), np.zeros(120))
    index = hardneg.Index(tree, np.dtype(np.int8), None)
    far = np.full((120, 1), 1 << 62)
    slots = hardneg.Slots(5, far, -far, np.full_like(far, np.iinfo(np.int64).max))
    cells, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: cells.append(len(a) * b.shape[1]) or matmul(a, b, out=out))
    for negatives, share in ((False, 1), (True, 5)):
        cells.clear()
        got = hardneg._looked_into(index, Sent(tree), Sent(who), Sent(slots), settings, blocks, negatives)
        assert sum(cells) == 120 * 200 * share
        score = x[at] @ x.T
        score = np.where((labels[at][:, None] == labels) != negatives, score, -(1 << 40))
        score[np.arange(120), at] = -(1 << 40)
        rows = {(a, k, s) for b in got for a, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        best = {(a, int(k), int(score[a, k])) for a in range(120) for k in np.lexsort((keys, -score[a]))[:5]}
        assert rows == best


def test_equal_rows_are_dropped_by_their_keys():
    slots = hardneg.Slots(2, np.array([[9]]), np.array([[-9]]), np.array([[np.iinfo(np.int64).max]]))
    best = hardneg.Best(slots, 100)
    best.add(np.zeros(5, int), np.array([7, 7, 7, 10, 3]), np.array([5, 4, 6, 1, 2]))
    best.settle()
    assert [c.tolist() for c in best.kept] == [[0, 0], [7, 7], [4, 5]] and (best.low[0], best.last[0]) == (7, 5)
