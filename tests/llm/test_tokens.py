"""Encoding, prefix counts and the token store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalspark.llm import bpe, token_counts, token_store
from signalspark.llm.pieces import byte_chars

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def mixed(seed, n=150):
    rnd = random.Random(seed)
    bits = [" ", "  ", "\n", "'s", "a", "the", "é", "1", "!!", "\t", "'", "ll", "re", "_", "\xa0", "²", "<|endoftext|>", "İ"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(tokenizer, odd):
    library = Tokenizer.from_file(tokenizer)
    texts = odd + mixed(1)
    for text, ids in zip(texts, bpe.encode_texts(tokenizer, texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert bpe.decode_ids(tokenizer, ids) == library.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 48])
def test_tree_gives_the_same_ids_for_any_leaf(tokenizer, leaf):
    merges, _ = bpe.coder(tokenizer)
    rnd = random.Random(leaf)
    pieces = ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 3, 10, 50, 333)]
    pieces.append(byte_chars("é日ß" * 40))
    whole = merges.encode(pieces, [True] * len(pieces))
    assert bpe.encode_tree(merges, pieces, leaf) == whole


def test_prefix_counts_equal_encoding_every_prefix(odd):
    library = Tokenizer.from_file(WORD)
    for text in ["internationalisation", "thethethe", "!!!???", "don't stop 42 times", "a" * 60]:
        found = token_counts.Prefixes(WORD, text)
        assert found.total() == len(library.encode(text, add_special_tokens=False).ids)
        for i, piece in enumerate(found.pieces):
            for inside in range(1, len(piece) + 1):
                own = len(library.encode(piece[:inside], add_special_tokens=False).ids)
                assert found.at(i, inside) == found.at(i) + own
        for budget in range(found.total() + 2):
            pieces, inside = found.fit(budget)
            assert found.at(pieces, inside) <= budget
            if (pieces, inside) != (len(found.pieces), 0):
                whole = inside + 1 == len(found.pieces[pieces])
                longer = found.at(pieces + 1) if whole else found.at(pieces, inside + 1)
                assert longer > budget or inside < len(found.pieces[pieces])


def test_token_counts(documents, tokenizer, odd):
    library = Tokenizer.from_file(tokenizer)
    rows = [*enumerate(odd), (None, "null key"), (3, None), (0, odd[0])]
    found = token_counts.token_counts(documents(rows), tokenizer, 20, running=True).collect()
    wanted = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == wanted
    for r in found:
        assert r.over_limit == (r.n_tokens > 20)
        assert r.running == sorted(r.running) and (r.running or [0])[-1] == r.n_tokens
        assert r.fit_pieces == sum(n <= 20 for n in r.running)


def test_digests_and_encode(documents, odd):
    library = Tokenizer.from_file(WORD)
    rows = [*enumerate(odd), (99, None)]
    docs = documents(rows)
    texts = {i: t or "" for i, t in rows}
    for r in bpe.digests(docs, WORD).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    made = bpe.encode(docs, WORD)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "text_hash", "n_tokens", "ids", "decoded"]
    assert {r.doc_id: len(r.ids) for r in made.collect()} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()
    }


def test_token_store(spark, documents, odd):
    library = Tokenizer.from_file(BYTE)
    rows = [(7 * i % 23, t) for i, t in enumerate(odd)] + [(1000, None), (None, "first of all")]
    folder = token_store.write(documents(rows), BYTE, 0)
    found = {r.key: r for r in token_store.checksums(token_store.starts(spark, folder)).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert found[i][1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    plan = token_store.starts(spark, folder).select("key", "start")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema") == 2 and "ids:array" not in plan


def test_empty_tables(spark, documents):
    docs = documents([])
    assert token_counts.token_counts(docs, WORD, 5).count() == 0
    assert bpe.digests(docs, WORD).count() == 0
    assert bpe.encode(docs, WORD).count() == 0
    folder = token_store.write(docs, BYTE, 0)
    assert token_store.starts(spark, folder).count() == 0


def test_stored_ids_are_not_shuffled_to_find_their_starts(spark, documents, tmp_path):
    """The sizes of the files go to the rows, however large Spark thinks they are."""
    from signalspark.llm import token_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_store.write(documents([(i, f"text {i}") for i in range(20)]), path, 0, (tmp_path / "ids").as_uri())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = token_store.starts(spark, folder)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.start, r.n_tokens) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [start for start, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(20)]
