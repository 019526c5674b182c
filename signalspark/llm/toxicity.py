"""Toxicity by subword bags and a linear softmax, trained together in NumPy.

A text's words count once each, where they first occur. A word is the mean of the vectors of its
character n-grams, a window of words the mean of its words (room left at the end counts as nothing),
and a softmax reads it. Labels hold for documents, so a document is toxic as soon as
one window is: its score is one minus the product of the windows' clean probabilities. Vectors and
softmax learn jointly from that score. Misspelt words share most n-grams with the word they hide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small
from signalspark.llm.kernel import HashIndex, Words, blocks, gather, mix, span_hashes, utf8

BUCKETS = 1 << 18
WINDOW = 16
SIZES = (3, 4, 5)
#: Means over a window are small when one word of many counts; the softmax reads them enlarged.
GAIN = 64.0
_U = np.uint64
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _cores(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the punctuation around them; words of punctuation alone stay as they are."""
    alnum = np.flatnonzero(_ALNUM[words.codes])
    starts, ends = words.starts[at], words.ends[at]
    if not len(alnum):
        return starts, ends
    first = np.searchsorted(alnum, starts)
    last = np.searchsorted(alnum, ends) - 1
    some = first <= last
    return np.where(some, alnum[np.minimum(first, len(alnum) - 1)], starts), np.where(some, alnum[last] + 1, ends)


def grams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, with word edges as part of them, and how many each has."""
    starts, ends = _cores(words, at)
    hashes, owner = [span_hashes(words.sums, starts, ends) + _U(1)], [np.arange(len(at))]
    for n in SIZES:
        counts = np.maximum(ends - starts - n + 1, 0)
        own = np.repeat(np.arange(len(at)), counts)
        begin = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        edge = (begin == starts[own]).astype(_U) * _U(7) + (begin + n == ends[own]).astype(_U) * _U(13)
        hashes.append(span_hashes(words.sums, begin, begin + n) + edge)
        owner.append(own)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (mix(np.concatenate(hashes)) & _U(BUCKETS - 1)).astype(np.int32)
    return buckets[order], np.bincount(owner, minlength=len(at))


def firsts(bounds: np.ndarray, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first occurrences of each text's words, in order, and where each text's begin."""
    _, place = np.unique(row.astype(np.int64) * (int(word.max(initial=0)) + 1) + word, return_index=True)
    place.sort()
    return place, np.searchsorted(place, bounds)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its text, and for each word its window; windows never cross texts."""
    sizes = np.diff(bounds)
    counts = -(-sizes // WINDOW)
    nth = np.arange(int(sizes.sum())) - np.repeat(bounds[:-1] - bounds[0], sizes)
    return np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts) - counts, sizes) + nth // WINDOW


@dataclass
class Model:
    """What scoring needs: for each bucket its vector's part of the logit, and the offset."""

    weights: np.ndarray
    offset: float


def _means(values: np.ndarray, begin: np.ndarray, end_of_all: int) -> np.ndarray:
    sizes = np.diff(np.append(begin, end_of_all))
    return np.add.reduceat(values, begin, axis=0) / sizes[:, None]


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as numbers of their words, where each begins, and the n-grams of every word."""
    index, words_of, sizes, grams_of, counts_of = HashIndex(16), [], [], [], []
    for at in range(0, len(texts), 64):
        raw, offsets = utf8(pa.array(texts[at : at + 64], pa.string()))
        for a, b in blocks(np.diff(offsets), 1 << 19):
            words = Words(raw, offsets[a : b + 1])
            fresh, first = np.unique(words.hashes, return_index=True)
            new = index.find(fresh) < 0
            found, counts = grams(words, first[new])
            grams_of.append(found)
            counts_of.append(counts)
            index.add(fresh[new])
            word = index.find(words.hashes)
            place, bounds = firsts(words.bounds, words.row, word)
            words_of.append(word[place].astype(np.int32))
            sizes.append(np.diff(bounds))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(words_of), bounds, np.concatenate(grams_of), np.concatenate(counts_of)


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, dim: int = 8, rounds: int = 8, seed: int = 7) -> Model:
    """Fit vectors and softmax by stochastic gradient steps with per-number step sizes.

    weight: what each row counts for. Rows without words teach nothing. Without both labels the
    model scores everything at the share of toxic rows.
    """
    share = float(np.average(toxic, weights=weight)) if len(texts) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    word, bounds, gram, gram_counts = _vocabulary(texts)
    gram_begin = np.cumsum(gram_counts) - gram_counts
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.01, (BUCKETS, dim)).astype(np.float32)
    softmax = np.zeros((dim, 2), np.float32)
    softmax[:, 1] = random.normal(0, 0.5, dim)
    offset = -4.0
    seen_v, seen_s, seen_o = np.full((BUCKETS, dim), 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), 1e-6
    full = np.flatnonzero(np.diff(bounds))
    scale = weight / weight.mean()
    for _ in range(rounds):
        for rows in np.array_split(random.permutation(full), max(1, len(full) // 64)):
            counts = np.diff(bounds)[rows]
            local = np.concatenate([[0], np.cumsum(counts)])
            picked = gather(bounds[:-1][rows], counts, word)
            own, inverse = np.unique(picked, return_inverse=True)
            ids = gather(gram_begin[own], gram_counts[own], gram)
            begin = np.cumsum(gram_counts[own]) - gram_counts[own]
            word_vectors = _means(vectors[ids], begin, len(ids))
            text, window = windows(local)
            heads = np.searchsorted(window, np.arange(len(text)))
            hidden = np.add.reduceat(word_vectors[inverse], heads, axis=0) * (GAIN / WINDOW)
            logit = hidden @ (softmax[:, 1] - softmax[:, 0]) + offset
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            clean = np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-7)), len(rows)))
            pull = np.where(toxic[rows] > 0, -clean / np.maximum(1 - clean, 1e-7), 1.0) * scale[rows]
            slope = (pull[text] * p / len(rows)).astype(np.float32)
            to_softmax = np.stack([-(hidden * slope[:, None]).sum(0), (hidden * slope[:, None]).sum(0)], axis=1)
            to_hidden = (GAIN / WINDOW) * slope[:, None] * (softmax[:, 1] - softmax[:, 0])
            to_words = to_hidden[window]
            touched, spot = np.unique(ids, return_inverse=True)
            gram_owner = np.repeat(np.arange(len(own)), gram_counts[own])
            for d in range(dim):
                per_word = np.bincount(inverse, to_words[:, d], len(own)) / gram_counts[own]
                step = np.bincount(spot, per_word[gram_owner], len(touched)).astype(np.float32)
                seen_v[touched, d] += step * step
                vectors[touched, d] -= 0.1 * step / np.sqrt(seen_v[touched, d])
            seen_s += to_softmax * to_softmax
            softmax -= 0.1 * to_softmax / np.sqrt(seen_s)
            pulled = float(slope.sum())
            seen_o += pulled * pulled
            offset -= 0.1 * pulled / np.sqrt(seen_o)
    return Model((GAIN * (vectors @ (softmax[:, 1] - softmax[:, 0]))).astype(np.float32), float(offset))


class Scorer:
    """Scores texts; the part of each word is computed once and kept, for ``limit`` words at a time."""

    def __init__(self, model: Model, limit: int = 1 << 20):
        self.model, self.limit = model, limit
        self.index, self.parts = HashIndex(16), np.empty(0, np.float32)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = Words(raw, offsets)
        out = np.zeros(len(offsets) - 1)
        if not len(words.starts):
            return out
        if len(self.parts) > self.limit:
            self.index, self.parts = HashIndex(16), np.empty(0, np.float32)
        at = self.index.find(words.hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = np.unique(words.hashes[new], return_index=True)
            gram, counts = grams(words, new[first])
            part = np.add.reduceat(self.model.weights[gram], np.cumsum(counts) - counts) / counts
            self.parts = np.concatenate([self.parts, part.astype(np.float32)])
            self.index.add(fresh)
            at[new] = self.index.find(words.hashes[new])
        place, bounds = firsts(words.bounds, words.row, at)
        text, window = windows(bounds)
        logit = np.bincount(window, self.parts[at[place]], len(text)) / WINDOW + self.model.offset
        clean = np.bincount(text, -np.logaddexp(0, logit), len(out))
        out = -np.expm1(clean)
        return np.clip(out, 0.0, 1.0)


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    toxic_rows: int = 3000, clean_rows: int = 6000, max_bytes: int = 1 << 16,
) -> Model:
    """Train on a bounded sample: of each label the rows first in order of a hash of their key.

    toxic_rows, clean_rows and max_bytes (longer texts are not learned from) bound what comes to the
    driver. The sample's rows are weighted to the labels' true shares. Labels other than 0 and 1 are
    left out; a key with both labels counts as toxic.
    """
    marks = labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("__key"))
    marks = marks.agg(F.max(F.col(f"`{label}`")).cast("int").alias("__toxic")).where("__key IS NOT NULL")
    totals = {r["__toxic"]: r["n"] for r in marks.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("__key").cast("string"))
    some = [
        marks.where(F.col("__toxic") == value).orderBy(order, "__key").limit(rows)
        for value, rows in ((1, toxic_rows), (0, clean_rows))
    ]
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    rows = rows.where(F.octet_length("__text") <= max_bytes)
    got = rows.join(F.broadcast(some[0].unionAll(some[1])), "__key").orderBy(order, "__key", F.xxhash64("__text"))
    got = got.limit(toxic_rows + clean_rows).select("__text", "__toxic").toArrow()
    toxic = np.array(got.column(1).to_pylist(), np.int64)
    counts = np.bincount(toxic, minlength=2)
    weight = np.array([totals.get(v, 0) / max(counts[v], 1) for v in (0, 1)])[toxic] if len(toxic) else toxic
    return train(got.column(0).to_pylist(), toxic, weight)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: ``key``, ``score`` from 0 to 1 and ``predicted``, 1 from the threshold on.

    Null texts and texts without words have score 0. Repeated rows are kept; other columns are not
    passed on; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))

    def run(batches):
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            for some in small(batch):
                found = scorer(*utf8(some.column(1)))
                high = pa.array((found >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found), high], [key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
