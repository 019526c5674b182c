import public_tokenizers
import pytest

#: Texts that tokenizers and splitters stumble over.
ODD = [
    "", "   ", " a  b\n\n c\t", "It's don't 's !!'s ''s x's I'LL we'Ve", "<|endoftext|>a <|startoftext|> b<|endoftext|>",
    "é İstanbul ΑΣ ſ ß   \x85 \x1c x", "日本語 ﬁ ½²³ 12345 ١٢", "a" * 500, "th" * 300 + "é" * 77 + "!" * 201,
    "x\n", "x \n y", " \n", "\n\nfoo   ", "\x00a\x00 b", "Á é Ω", "ümlaut's " * 50, "0123456789" * 30,
]


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture(params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def tokenizer(request):
    return public_tokenizers.path(request.param)


@pytest.fixture
def documents(spark):
    """Make a documents table with an extra column whose name the operators use inside."""

    def make(rows):
        rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows]
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string"
        return spark.createDataFrame(rows, kinds)

    return make
