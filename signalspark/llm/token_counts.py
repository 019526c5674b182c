"""Exact token counts at every prefix, by dynamic programming over prefixes.

Byte-pair sequences have a local test: a sequence is what the merges give exactly if each two
neighbours are. So the encoding of a prefix is the encoding of a shorter prefix and one more token,
and the pair at the seam decides which. One pass over a piece finds the last token and the count at
every prefix; truncation and budget questions are then look-ups, and nothing is encoded again.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.bpe import small, texts_of
from signalspark.llm.pieces import PieceTable, Splitter


class PrefixCounter:
    """Counts under the vocabulary and merges of one tokenizer file, on byte characters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _symbols(self, token: str) -> list[str]:
        if self.mark and token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether the merges of a token's own characters end in that token."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self._merged(self._symbols(token)) == [token]
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are side by side."""
        found = self._fits.get((left, right))
        if found is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            found = self._merged(self._symbols(left) + self._symbols(right)) == [left, right]
            self._fits[left, right] = found
        return found

    def _last(self, piece: str, end: int, lasts: list[str], mark: str) -> tuple[str, int]:
        """The last token of the prefix up to ``end``, and where it begins."""
        vocab = self.vocab
        for begin in range(max(0, end - self.longest), end):
            token = piece[begin:end] + mark
            if token in vocab and (self.fits(lasts[begin], token) if begin else self.whole(token)):
                return token, begin
        raise ValueError("the vocabulary lacks a byte")

    def open_counts(self, piece: str) -> tuple[list[int], list[str]]:
        """Counts and last tokens of the prefixes that do not end the piece."""
        counts, lasts = [0], [""]
        for end in range(1, len(piece)):
            token, begin = self._last(piece, end, lasts, "")
            counts.append(counts[begin] + 1)
            lasts.append(token)
        return counts, lasts

    def count(self, piece: str) -> int:
        """Tokens of a whole piece."""
        counts, lasts = self.open_counts(piece)
        return counts[self._last(piece, len(piece), lasts, self.mark)[1]] + 1 if piece else 0

    def prefix_counts(self, piece: str) -> list[int]:
        """Tokens of every prefix, each taken as a piece of its own; the empty one first."""
        counts, lasts = self.open_counts(piece)
        ends = (self._last(piece, end, lasts, self.mark)[1] for end in range(1, len(piece) + 1))
        return [0, *(counts[begin] + 1 for begin in ends)]


@cache
def counter(path: str) -> tuple[PrefixCounter, PieceTable]:
    splitter = Splitter(path)
    prefixes = PrefixCounter(splitter.spec)

    def compute(pieces: list[str]) -> list[np.ndarray]:
        return [np.array([prefixes.count(p)], np.int32) for p in pieces]

    return prefixes, PieceTable(splitter, compute, lambda _: np.ones(1, np.int32))


def running_counts(path: str, texts: list[str]):
    """For each text the number of tokens up to the end of each of its pieces."""
    _, table = counter(path)
    for _, _, bounds, values, _ in table.read(texts):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield values[a:b].cumsum(dtype=np.int64)


class Prefixes:
    """The stored counts of one text: piece ends with running counts, and prefixes inside a piece.

    Positions are numbers of pieces and bytes (byte characters) inside the next piece.
    """

    def __init__(self, path: str, text: str):
        self.prefixes, table = counter(path)
        self.pieces = table.splitter.slow(text)
        sizes = [1 if isinstance(p, int) else self.prefixes.count(p) for p in self.pieces]
        self.running = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def total(self) -> int:
        return int(self.running[-1])

    def at(self, pieces: int, inside: int = 0) -> int:
        """Tokens of the first pieces and of the first bytes of the next one."""
        extra = self.prefixes.prefix_counts(self.pieces[pieces])[inside] if inside else 0
        return int(self.running[pieces]) + extra

    def fit(self, budget: int) -> tuple[int, int]:
        """The longest prefix within a budget, as (pieces, bytes of the next piece)."""
        whole = int(np.searchsorted(self.running, budget, side="right")) - 1
        if whole == len(self.pieces) or isinstance(self.pieces[whole], int):
            return whole, 0
        left = budget - int(self.running[whole])
        inside = self.prefixes.prefix_counts(self.pieces[whole])
        return whole, max(i for i, n in enumerate(inside) if n <= left)


def token_counts(
    docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", running: bool = False
) -> DataFrame:
    """Per row: ``key``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit), and
    ``fit_pieces``, how many whole pieces fit into the limit.

    running: also ``running`` array<bigint>, the count at the end of every piece. Null and empty
    texts have 0 of all; repeated rows are kept, other columns of the input are not passed on.
    """

    def run(batches):
        for batch in batches:
            for some in small(batch):
                texts = texts_of(some, "__text")
                rows = list(running_counts(path, texts))
                totals = np.array([int(r[-1]) if len(r) else 0 for r in rows], np.int64)
                fit = [int(np.searchsorted(r, limit, side="right")) for r in rows]
                columns = [
                    some.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals),
                    pa.array(totals > limit),
                    pa.array(fit, pa.int64()),
                ]
                names = [key, "n_bytes", "n_tokens", "over_limit", "fit_pieces"]
                if running:
                    columns.append(pa.array([r.tolist() for r in rows], pa.list_(pa.int64())))
                    names.append("running")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    made = f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_pieces bigint"
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return picked.mapInArrow(run, made + (", running array<bigint>" if running else ""))
