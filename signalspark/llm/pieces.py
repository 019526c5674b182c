"""Cut texts into the pieces that byte-pair merges never cross, for two public tokenizer files.

Characters whose class and lower case are the same in every Unicode version go through array code;
a text with any other character, and any special string, takes the tokenizers library's own
normaliser and splitter. Both ways give the same pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from signalspark.llm.kernel import HashIndex, blocks, flags_to_spans, gather, prefix_hashes, span_hashes

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
_TOP = 0x250
_APOSTROPHE = re.compile(r"'(?=[sStTmMdD]|[rRvV][eE]|[lL][lL])")
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0]


def _classes() -> np.ndarray:
    """Class of each plain character; the last entry stands for all others."""
    out = np.full(_TOP + 1, OTHER, np.int8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[_BLANKS] = SPACE
    return out


def _lowers() -> np.ndarray:
    return np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_TOP)], np.uint32)


_CLASS, _LOWER = _classes(), _lowers()
#: Bytes as the printable characters that byte-level vocabularies use for them (fixed values: the
#: printable bytes stand for themselves, the others follow from 256 on).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_rest = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_rest)}


def byte_chars(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


class Splitter:
    """Pieces of texts under one tokenizer file.

    ``lowered`` files normalise (composed form, lower case) and drop white space; the others keep
    every character, and a space belongs to the word after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lowered = self.spec["normalizer"] is not None
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")

    def plain(self, text: str) -> bool:
        """Whether array code may cut the text."""
        if any(s in text for s in self.specials) or (not text.isascii() and _has_odd(text, self.lowered)):
            return False
        return _APOSTROPHE.search(text) is None

    def slow(self, text: str) -> list[str | int]:
        """Pieces by the library, as byte characters; special strings as their ids."""
        out: list[str | int] = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                if self.lowered:
                    part = self.library.normalizer.normalize_str(part)
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part) if p]
        return out

    def fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of a block of plain texts, starts and ends of its pieces, and where each text's pieces begin."""
        codes = np.frombuffer("\x00".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if self.lowered:
            codes = _LOWER[codes]
        kind = _CLASS[codes]
        edges = np.cumsum(sizes[:-1] + 1) - 1
        kind[edges] = EDGE
        breaks = np.zeros(len(codes), bool)
        if self.lowered:  # runs of one class; each number character stands alone
            breaks[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
            starts, ends = flags_to_spans((kind != SPACE) & (kind != EDGE), breaks)
        else:
            # A new piece starts where the class changes, but not after a plain space, which joins what
            # follows it; the last of several blanks before a character leaves the run of blanks.
            breaks[1:] = kind[1:] != kind[:-1]
            before = np.zeros(len(codes), bool)
            before[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE)
            breaks |= before
            joined = np.zeros(len(codes), bool)
            joined[1:] = before[:-1] & (codes[:-1] == 32)
            breaks &= ~joined
            starts, ends = flags_to_spans(kind != EDGE, breaks)
        begin = np.concatenate([[0], edges + 1]) if len(texts) else np.empty(0, np.int64)
        return codes, starts, ends, np.append(np.searchsorted(starts, begin), len(starts))


def _has_odd(text: str, lowered: bool) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool((codes >= _TOP).any() or (lowered and (codes == 0x130).any()))


class PieceTable:
    """Values of pieces, each computed once and kept under the piece's hash.

    ``compute`` maps a list of pieces (byte characters) to one int32 array or list each, ``special_value``
    the id of a special string to one. After ``limit`` pieces the table starts anew, so its memory
    is bounded.
    """

    def __init__(self, splitter: Splitter, compute, special_value, limit: int = 1 << 20):
        self.splitter, self.compute, self.special_value, self.limit = splitter, compute, special_value, limit
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(16)
        self.values, self.used = np.empty(1 << 16, np.int32), 0
        self.starts = np.empty(0, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = self.compute(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        need = self.used + int(sizes.sum())
        if need > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.empty(need * 2 - self.used, np.int32)])
        if len(found):
            lists = isinstance(found[0], list)
            self.values[self.used : need] = (
                np.fromiter(chain.from_iterable(found), np.int32, need - self.used) if lists else np.concatenate(found)
            )
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.used = need
        self.index.add(hashes)

    def _lookup(self, hashes: np.ndarray, pieces_at) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the values of pieces; pieces_at(numbers) gives the texts of some."""
        if len(self.index.known) > self.limit:
            self._clear()
        at = self.index.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            self._learn(fresh, pieces_at(new[first]))
            at[new] = self.index.find(hashes[new])
        ends = np.append(self.starts[1:], self.used)
        return self.starts[at], ends[at] - self.starts[at]

    def read(self, texts: list[str]):
        """(first, last, bounds, values, lengths) for runs of texts.

        ``values`` has the values of all pieces of texts[first:last] in order, ``bounds`` where each
        text's values begin, the end last; ``lengths`` the number of values of each piece.
        """
        plain = np.fromiter(map(self.splitter.plain, texts), bool, len(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        runs = np.flatnonzero(np.diff(plain)) + 1
        for lo, hi in zip([0, *runs.tolist()], [*runs.tolist(), len(texts)], strict=True):
            for a, b in blocks(sizes[lo:hi]):
                a, b = lo + a, lo + b
                if a < b:
                    yield a, b, *(self._fast(texts[a:b]) if plain[a] else self._slow(texts[a:b]))

    def _fast(self, texts):
        codes, starts, ends, bounds = self.splitter.fast(texts)
        hashes = span_hashes(prefix_hashes(codes), starts, ends)

        def pieces_at(some):
            sizes = ends[some] - starts[some]
            inside = gather(starts[some], sizes, codes)
            text = byte_chars(inside.tobytes().decode("utf-32-le"))
            width = np.concatenate([[0], np.cumsum(1 + (inside >= 0x80) + (inside >= 0x800) + (inside >= 0x10000))])
            edges = width[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

        begin, sizes = self._lookup(hashes, pieces_at)
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return totals[bounds], gather(begin, sizes, self.values), sizes

    def _slow(self, texts):
        bounds, values, lengths = [0], [], []
        for text in texts:
            for part in self.splitter.slow(text):
                found = np.asarray(self.special_value(part) if isinstance(part, int) else self.compute([part])[0], np.int32)
                values.append(found)
                lengths.append(len(found))
            bounds.append(sum(lengths))
        joined = np.concatenate(values) if values else np.empty(0, np.int32)
        return np.array(bounds, np.int64), joined, np.array(lengths, np.int64)
