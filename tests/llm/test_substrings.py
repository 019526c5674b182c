"""Substring dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from signalspark.llm import substrings

KIND = "doc_id bigint, text string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (key, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            span, place = tuple(w[i : i + window]), (key is None, key or 0)
            first[span] = min(first.get(span, place), place)
    out = defaultdict(list)
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key is None, key or 0):
                gone |= set(range(i, i + window))
        out[key].append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return {k: sorted(v) for k, v in out.items()}


def found(spark, rows, settings, kind=KIND):
    out = defaultdict(list)
    frame = spark.createDataFrame(rows, kind)
    for r in substrings.dedup_substrings(frame, settings).collect():
        out[r.doc_id].append((r.n_words, r.n_removed, r.kept))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, n, letters, longest):
    """Documents that share passages, with words changed, put in and left out."""
    rnd = random.Random(seed)

    def prose(k):
        return [rnd.choice(letters) for _ in range(k)]

    passages = [prose(rnd.randrange(1, longest)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(4)):
            words += prose(rnd.randrange(longest)) + [w for w in rnd.choice(passages) if rnd.random() > 0.02]
            if words and rnd.random() < 0.5:
                words[rnd.randrange(len(words))] = rnd.choice(letters)
        rows.append((rnd.randrange(3 * n), rnd.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize(
    "seed, settings, letters",
    [
        (1, substrings.Settings(5, 2, 4), "ab"), (2, substrings.Settings(6, 3, 8), "abcdef"),
        (3, substrings.Settings(4, 4, 16), "abcdefghij"), (4, substrings.Settings(12, 5, 10), "abcdefghijklmnopq"),
    ],
)
def test_equals_brute_force(spark, seed, settings, letters):
    rows = corpus(seed, 60, letters, 3 * settings.window)
    rows += [(None, rows[3][1]), (None, "a b " * 20), (900, None), (901, ""), (902, " \n "), rows[5], rows[5], (rows[7][0], rows[8][1])]
    kinds = KIND + ", key string, text_hash string, spans string"
    got = found(spark, [(*r, "x", "y", "z") for r in rows], settings, kinds)
    assert got == brute(rows, settings.window)


def test_production_parameters(spark):
    words = [f"w{i}" for i in range(400)]
    rows = corpus(5, 50, words, 200) + [(1000 + i, " ".join(words[:120])) for i in range(200)]
    assert found(spark, rows, substrings.Settings()) == brute(rows, 50)


def test_every_shared_window_has_an_equal_anchor():
    rnd, settings = np.random.default_rng(1), substrings.Settings(8, 3, 16)
    from signalspark.llm.kernel import Words

    text = " ".join(rnd.choice(list("abc"), 300))
    for other in (text, "x y " + text, text[100:]):
        raw = np.frombuffer(other.encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]), lower=False)
        _, _, at = substrings.anchors(words, settings)
        for i in range(len(words.hashes) - 7):
            assert ((at >= i) & (at <= i + 5)).any()


def test_a_very_long_text_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(f"q{i}" for i in range(150_000)) + " " + passage
    rows = [(5, passage + " tail"), (3, long), (4, "head " + passage), (2, "none of it")]
    got = found(spark, rows, substrings.Settings())
    assert got[3] == [(150_070, 0, long)] and got[4] == [(71, 70, "head")] and got[5] == [(71, 70, "tail")]
    assert found(spark, [], substrings.Settings()) == {}
    assert found(spark, [(1, None), (None, None)], substrings.Settings()) == {1: [(0, 0, "")], None: [(0, 0, "")]}
