"""Byte-pair encoding and decoding, with tree concatenation for long unsplit text.

Merges never cross a piece, so pieces are encoded once each. A long piece is cut into leaves that
are encoded side by side; then neighbours are joined, level by level: a window of tokens around the
join is encoded anew and grows until its first token is the left side's and its last token the
right side's. From there on both sides agree, and the result is what encoding the whole gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.pieces import PieceTable, Splitter

LEAF = 48
_BATCH = 4096


class Merges:
    """The merges of a tokenizer file on byte characters.

    ``closed`` pieces end with the file's end-of-word mark, if it has one; ``open`` ones go on.
    """

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "decoder": None}
        bare |= {"post_processor": None, "truncation": None, "padding": None}
        self.mark = spec["model"].get("end_of_word_suffix") or ""
        self._closed = Tokenizer.from_str(json.dumps(bare))
        self._open = self._closed
        if self.mark:
            self._open = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.names = {i: t for t, i in spec["model"]["vocab"].items()}
        size = max([*self.names, *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [self.names.get(i, "") for i in range(size)]
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]

    def encode(self, pieces: list[str], closed: list[bool]) -> list[list[int]]:
        """Ids of many pieces, the library's threads working side by side."""
        if all(closed):
            return [e.ids for at in range(0, len(pieces), _BATCH)
                    for e in self._closed.encode_batch(pieces[at : at + _BATCH], add_special_tokens=False)]
        out: list = [None] * len(pieces)
        for want, coder in ((True, self._closed), (False, self._open)):
            mine = [i for i, c in enumerate(closed) if c is want or c == want]
            for at in range(0, len(mine), _BATCH):
                some = mine[at : at + _BATCH]
                for i, e in zip(some, coder.encode_batch([pieces[i] for i in some], add_special_tokens=False), strict=True):
                    out[i] = e.ids
        return out

    def text(self, ids: list[int], ends: bool) -> str:
        """The byte characters of tokens inside one piece; ``ends``: the last has the mark."""
        joined = "".join(map(self.tokens.__getitem__, ids))
        return joined[: -len(self.mark)] if ends and self.mark else joined


def encode_tree(merges: Merges, pieces: list[str], leaf: int = LEAF) -> list[list[int]]:
    """Ids of pieces of any length; all leaves, and all joins of a level, are encoded side by side."""
    long = [i for i, piece in enumerate(pieces) if len(piece) > leaf]
    if len(long) < len(pieces):  # a piece of one leaf has nothing to join
        out: list = merges.encode([p for p in pieces if len(p) <= leaf], [True] * (len(pieces) - len(long)))
        for i, ids in zip(long, encode_tree(merges, [pieces[i] for i in long], leaf) if long else [], strict=True):
            out.insert(i, ids)
        return out
    leaves, owner, closed = [], [], []
    for k, piece in enumerate(pieces):
        cuts = range(0, max(len(piece), 1), leaf)
        leaves += [piece[i : i + leaf] for i in cuts]
        owner += [k] * len(cuts)
        closed += [False] * (len(cuts) - 1) + [True]
    nodes = list(zip(owner, merges.encode(leaves, closed), closed, strict=True))
    while len(nodes) > len(pieces):
        paired, alone, i = [], [], 0
        order = []
        while i < len(nodes):
            if i + 1 < len(nodes) and nodes[i][0] == nodes[i + 1][0]:
                order.append((True, len(paired)))
                paired.append((nodes[i], nodes[i + 1]))
                i += 2
            else:
                order.append((False, len(alone)))
                alone.append(nodes[i])
                i += 1
        joined = _join(merges, paired)
        nodes = [joined[k] if pair else alone[k] for pair, k in order]
    return [ids for _, ids, _ in nodes]


def _join(merges: Merges, pairs: list) -> list:
    done: list = [None] * len(pairs)
    waiting = [(k, 1) for k in range(len(pairs))]
    while waiting:
        windows, closed = [], []
        for k, width in waiting:
            (_, left, _), (_, right, last) = pairs[k]
            end = last and width >= len(right)
            windows.append(merges.text(left[-width:] + right[:width], end))
            closed.append(end)
        again = []
        for (k, width), ids in zip(waiting, merges.encode(windows, closed), strict=True):
            (owner, left, _), (_, right, last) = pairs[k]
            if (width >= len(left) or ids[0] == left[-width]) and (width >= len(right) or ids[-1] == right[width - 1]):
                done[k] = (owner, left[:-width] + ids + right[width:], last)
            else:
                again.append((k, width * 2))
        waiting = again
    return done


@cache
def coder(path: str) -> tuple[Merges, PieceTable]:
    """One per worker and file; pieces met before stay known from task to task."""
    splitter = Splitter(path)
    merges = Merges(splitter.spec)

    def compute(pieces: list[str]) -> list[list[int]]:
        return encode_tree(merges, pieces)

    return merges, PieceTable(splitter, compute, lambda i: np.array([i], np.int32))


def encode_texts(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text, in order; as the library gives them without added special tokens."""
    _, table = coder(path)
    for _, _, bounds, values, _ in table.read(texts):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield values[a:b]


def decode_ids(path: str, ids: np.ndarray) -> str:
    """The text of ids, special ones included, as the file's own decoder joins them."""
    merges, table = coder(path)
    tokens = list(map(merges.tokens.__getitem__, ids.tolist()))
    if table.splitter.spec["decoder"] is None:
        return " ".join(tokens)
    return table.splitter.library.decode(ids.tolist(), skip_special_tokens=False)


def texts_of(batch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with ``ids`` array<int>, their ``n_tokens``, and ``decoded``, the text the ids give back.

    keep: the columns to pass on (default: all but the text; names of the three new columns are
    replaced). Null texts count as empty and have no ids; repeated rows are kept; an empty table
    gives no rows. One output row for each input row.
    """
    made = ("n_tokens", "ids", "decoded")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for batch in batches:
            for some in small(batch):
                rows = list(encode_texts(path, texts_of(some, "__text")))
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)),
                )
                decoded = pa.array([decode_ids(path, r) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in keep), pa.array(sizes), ids, decoded], [*keep, *made]
                )

    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    return picked.mapInArrow(run, ", ".join([*fields, "n_tokens bigint", "ids array<int>", "decoded string"]))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids_sha256`` of the ids as little-endian unsigned 32-bit
    integers and ``decoded_sha256`` of the decoded text in UTF-8, both lower-case hex."""

    def run(batches):
        for batch in batches:
            for some in small(batch):
                sizes, ids_sha, text_sha = [], [], []
                for ids in encode_texts(path, texts_of(some, "__text")):
                    sizes.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(decode_ids(path, ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def small(batch, column: str = "__text", limit: int = 1 << 20) -> Iterator:
    """An Arrow batch in pieces of about ``limit`` bytes of text, one row at least."""
    from signalspark.llm.kernel import blocks, utf8

    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    for a, b in blocks(np.diff(offsets), limit):
        yield batch.slice(a, b - a)
