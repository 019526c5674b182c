"""Array code shared by the text operators: blocks of texts, spans in them, and 64-bit span hashes.

A batch of texts becomes blocks of half a million characters; everything on a block is whole-array
work. A single text longer than a block is a block of its own, so memory is bounded by the larger
of the block size and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1024)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=_U)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running hash sums; differences give the hash of any span."""
    x = (codes.astype(_U) + _U(0x632BE59BD9B4E019)) * _U(0xA24BAED4963EE407)
    x ^= x >> _U(31)
    x *= _powers(len(codes))[0]
    out = np.empty(len(codes) + 1, _U)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal content has equal hashes wherever it stands."""
    inverse = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def flags_to_spans(inside: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run also ends before a position marked in ``breaks``."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1] if breaks is None else (~inside[:-1] | breaks[1:])
    last = inside.copy()
    last[:-1] &= ~inside[1:] if breaks is None else (~inside[1:] | breaks[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def blocks(lengths: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts with these lengths into runs of about ``limit`` characters."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(lengths):
        yield at, len(lengths)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, with their hashes.

    row: the text of each word; bounds: where each text's words begin, with the end last.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True, lines: bool = False):
        base = int(offsets[0])
        codes = raw[base : int(offsets[-1])]
        starts_of = offsets - base
        breaks = np.zeros(len(codes) + 1, bool)
        breaks[starts_of] = True
        self.starts, self.ends = flags_to_spans(~_SPACE[codes], breaks[:-1])
        if lower:
            codes = _LOWER[codes]
        self.codes = codes
        self.sums = prefix_hashes(codes)
        self.hashes = span_hashes(self.sums, self.starts, self.ends)
        if lines:  # each text's pieces between newlines count as the rows
            breaks_at = np.flatnonzero(codes == 10)
            marks = np.concatenate([starts_of[:-1], breaks_at + 1])
            text_of = np.concatenate(
                [np.arange(len(starts_of) - 1), np.searchsorted(starts_of[1:], breaks_at, side="right")]
            )
            order = np.lexsort((marks, text_of))
            self.row_starts, self.row_text = marks[order], text_of[order]
            first = np.searchsorted(self.row_text, np.arange(len(starts_of) - 1))
            self.row_line = np.arange(len(marks)) - first[self.row_text]
            self.bounds = np.searchsorted(self.starts, np.append(self.row_starts, len(codes)))
        else:
            self.bounds = np.searchsorted(self.starts, starts_of)
        self.rows = len(self.bounds) - 1
        self.row = np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row within a text, and the text of each.

        A text of fewer words gives one hash of all of them, a text without words none.
        """
        n, counts = len(self.hashes), np.diff(self.bounds)
        inverse = _powers(n + 1)[1]
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum(mix(self.hashes) * _powers(n)[0], out=sums[1:])
        first = np.arange(n)
        last = self.bounds[1:][self.row]
        whole = first + k <= last
        at = np.flatnonzero(whole | ((first == self.bounds[:-1][self.row]) & (counts[self.row] < k)))
        end = np.minimum(at + k, last[at])
        return mix((sums[end] - sums[at]) * inverse[at] + (end - at).astype(_U)), self.row[at]


class HashIndex:
    """64-bit hashes numbered in order of arrival: an open-addressing table on arrays."""

    def __init__(self, bits: int = 12):
        self._resize(bits)
        self.known = np.empty(0, _U)

    def _resize(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, _U)
        self.places = np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for unknown ones."""
        slot = (hashes & _U(self.mask)).astype(np.int64)
        out = self.places[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.places[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != hashes[todo])]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new, different hashes after the known ones."""
        self.known = np.concatenate([self.known, hashes])
        if len(self.known) * 2 > self.mask:
            self._resize(max(12, int(len(self.known) * 4).bit_length()))
            self._place(self.known, 0)
        else:
            self._place(hashes, len(self.known) - len(hashes))

    def _place(self, hashes: np.ndarray, first: int) -> None:
        todo = np.arange(len(hashes))
        slot = (hashes & _U(self.mask)).astype(np.int64)
        while len(todo):
            free = self.places[slot[todo]] < 0
            mine = todo[free]
            self.places[slot[mine]] = first + mine
            won = self.places[slot[mine]] == first + mine
            self.keys[slot[mine[won]]] = hashes[mine[won]]
            lost = np.concatenate([todo[~free], mine[~won]])
            slot[lost] = (slot[lost] + 1) & self.mask
            todo = lost


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]`` one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begin = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - begin, lengths) + np.arange(total)]


def parities(values: np.ndarray, starts: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Parity bits of some sets as columns of 64 bits each: every member of a set flips one bit.

    values holds the sets one after another, starts where each begins; none of those in ``at`` may be
    empty. Two sets' bits differ in no more places than the sets differ in members. words: a power of 2.
    """
    sizes = np.diff(starts)[at]
    ends = np.cumsum(sizes)
    own = mix(gather(starts[at], sizes, values))
    bits = _U(1) << (own & _U(63))
    word = (own >> _U(6)) & _U(words - 1)
    out = []
    for i in range(words):
        part = np.where(word == _U(i), bits, _U(0))
        out.append((np.bitwise_xor.reduceat(part, ends - sizes) if len(at) else part).view(np.int64))
    return out


def differ(left: str, right: str, columns):
    """In how many parity bits two aliased frames' rows differ, as a column."""
    from pyspark.sql import functions as F

    out = F.lit(0)
    for c in columns:
        out = out + F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}")))
    return out
