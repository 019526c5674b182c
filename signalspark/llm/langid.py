"""Language ID by mixture inference.

Each language is a distribution over hashed letter trigrams, counted over all learning rows. A
document is a mixture: every word comes from one language, and expectation-maximisation finds the
proportions. The language set is chosen by penalised likelihood: languages join in order of their
proportion as long as the gain in log likelihood exceeds half a log of the word count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small
from signalspark.llm.kernel import flags_to_spans, utf8
from signalspark.llm.shared import landed

BUCKETS = 1 << 16
UNKNOWN = "und"
_STEPS = 8


def _codes() -> np.ndarray:
    """Letter codes of bytes: ASCII letters in lower case, bytes of longer characters as they are, others 0."""
    out = np.zeros(256, np.uint32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = out[97:123]
    out[128:] = np.arange(27, 155)
    return out


_CODE = _codes()


class _Trigrams:
    """Trigram buckets of the words of a run of texts; one for each byte of a word, blanks around it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        marks = offsets - base
        code = _CODE[raw[base : int(offsets[-1])]]
        breaks = np.zeros(len(code) + 1, bool)
        breaks[marks] = True
        self.starts, self.ends = flags_to_spans(code > 0, breaks[:-1])
        left, right = np.zeros_like(code), np.zeros_like(code)
        left[1:], right[:-1] = code[:-1], code[1:]
        left[breaks[:-1]] = 0
        right[:-1][breaks[1:-1]] = 0
        gram = ((left * np.uint32(155) + code) * np.uint32(155) + right) * np.uint32(2654435761)
        inside = np.flatnonzero(code > 0)
        self.grams = (gram >> np.uint32(16))[inside]
        sizes = self.ends - self.starts
        self.begin = np.cumsum(sizes) - sizes
        self.bounds = np.searchsorted(self.starts, marks)
        self.gram_bounds = np.append(self.begin, len(self.grams))[self.bounds]


@dataclass
class Model:
    """``scores[bucket, language]``: log probabilities; languages in alphabetical order."""

    languages: list[str]
    scores: np.ndarray


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", max_languages: int = 256) -> Model:
    """Count the trigrams of all rows by language; rows without text or language are left out.

    The model has 65,536 numbers per language. max_languages bounds it: a table with more values of
    ``lang`` raises, as leaving some out would give their documents another language.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("__text"))

    def count(batches):
        found: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in found.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    ["lang", "bucket", "n"],
                )
            found.clear()

        for batch in batches:
            for some in small(batch):
                grams = _Trigrams(*utf8(some.column(1)))
                bounds = grams.gram_bounds.tolist()
                for i, name in enumerate(some.column(0).to_pylist()):
                    if name not in found:
                        if len(found) >= 32:
                            yield from flush()
                        found[name] = np.zeros(BUCKETS, np.int64)
                    found[name] += np.bincount(grams.grams[bounds[i] : bounds[i + 1]], minlength=BUCKETS)
        yield from flush()

    counted = rows.where("lang IS NOT NULL AND __text IS NOT NULL").mapInArrow(count, "lang string, bucket int, n bigint")
    sums = landed(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    pages = sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    if sums.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"column {lang} has more than {max_languages} languages; raise max_languages to learn them all")
    best = sorted(pages.select("lang", "counts").collect(), key=lambda r: r["lang"])
    scores = np.zeros((BUCKETS, len(best)), np.float32)
    for k, row in enumerate(best):
        counts = np.full(BUCKETS, 0.05)
        counts[np.fromiter(row["counts"].keys(), np.int64)] += np.fromiter(row["counts"].values(), np.int64)
        scores[:, k] = np.log(counts / counts.sum())
    return Model([r["lang"] for r in best], scores)


def _mixture(likelihood, row, begin, allowed):
    """Proportions and log likelihood of each text under its allowed languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    words = np.diff(np.append(begin, len(row)))[:, None]
    for _ in range(_STEPS):
        part = likelihood * share[row]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begin, axis=0) / words
    total = (likelihood * share[row]).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), begin)


def mixtures(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages for each text; all 0 for texts without words."""
    texts, k = len(offsets) - 1, len(model.languages)
    out = np.zeros((texts, k))
    grams = _Trigrams(raw, offsets)
    if not len(grams.starts) or not k:
        return out
    score = np.add.reduceat(model.scores[grams.grams], grams.begin, axis=0).astype(np.float64)
    score -= score.max(1, keepdims=True)
    likelihood = np.exp(np.maximum(score, -600))
    counts = np.diff(grams.bounds)
    full = np.flatnonzero(counts)
    begin, row = grams.bounds[:-1][full], np.repeat(np.arange(len(full)), counts[full])
    share, _ = _mixture(likelihood, row, begin, np.ones((len(full), k)))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    chosen, best = _mixture(likelihood, row, begin, (rank < 1).astype(float))
    price = 0.5 * np.log(counts[full] + 1)
    open_ = np.ones(len(full), bool)
    for size in range(2, k + 1):
        wider, found = _mixture(likelihood, row, begin, (rank < size).astype(float))
        open_ &= found - best > price
        if not open_.any():
            break
        chosen[open_], best[open_] = wider[open_], found[open_]
    out[full] = chosen
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None):
    """Per row: the columns of ``keep`` (default: ``key``), ``lang_pred``, ``score`` (its share),
    ``languages`` and ``shares`` (the chosen set, largest first).

    Null texts and texts without a letter give ``und``, 0 and empty lists, and so does a model
    without languages. Ties go to the first language in alphabetical order. Repeated rows are kept.
    """
    keep = [key] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores))

    def run(batches):
        found = Model(*sent.value)
        names = np.array([*found.languages, UNKNOWN], object)
        for batch in batches:
            for some in small(batch):
                column = some.column("__text")
                shares = mixtures(found, *utf8(column))
                best = shares.argmax(1) if shares.shape[1] else np.zeros(len(shares), np.int64)
                top = shares.max(1) if shares.shape[1] else np.zeros(len(shares))
                plain = [any(map(str.isalpha, t or "")) for t in column.to_pylist()]
                known = (top > 0) & np.array(plain, bool)
                order = np.argsort(-shares, axis=1, kind="stable")
                sets = [[int(j) for j in o if s[j] > 0] if y else [] for o, s, y in zip(order, shares, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(some.column("__text" if c == text else c) for c in keep),
                        pa.array(names[np.where(known, best, len(found.languages))], pa.string()),
                        pa.array(np.where(known, np.minimum(top, 1.0), 0.0)),
                        pa.array([[found.languages[j] for j in s] for s in sets], pa.list_(pa.string())),
                        pa.array([[float(x[j]) for j in s] for s, x in zip(sets, shares, strict=True)], pa.list_(pa.float64())),
                    ],
                    [*keep, "lang_pred", "score", "languages", "shares"],
                )

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    # A text that is kept is sent once.
    picked = docs.select(*(F.col(f"`{c}`") for c in keep if c != text), F.col(f"`{text}`").alias("__text"))
    made = "lang_pred string, score double, languages array<string>, shares array<double>"
    return picked.mapInArrow(run, ", ".join([*fields, made]))


def remainder(key: str, divisor: int):
    """crc32 of an id as text, modulo a divisor; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % divisor
