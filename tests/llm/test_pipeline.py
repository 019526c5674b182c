"""The pipeline on a small corpus whose outcome is known."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from signalspark.llm import stages

WORDS = {
    "en": [f"the{a}{b}" for a in "bcdfgh" for b in "aeiouy"],
    "de": [f"ö{a}{b}sch" for a in "klmnpr" for b in "aeiouü"],
}


def prose(rnd, lang, n=60):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + "."


def corpus(spark, folder):
    rnd = random.Random(9)
    item = prose(rnd, "en", 30)
    rows = [(i, prose(rnd, lang) + "\n" + prose(rnd, lang), lang) for i, lang in enumerate(["en", "de"] * 30)]
    shared = prose(rnd, "en", 12)
    rows[3] = (3, rows[3][1] + "\n" + shared, "de")
    rows[5] = (5, rows[5][1] + "\n" + shared, "de")
    rows.append((100, rows[0][1], "en"))  # a copy
    near = rows[2][1].split()
    near[45] = "changed"
    rows.append((101, "\n".join(" ".join(near[a:b]) for a, b in ((0, 30), (30, 90), (90, 120))), "en"))  # other lines
    rows.append((102, prose(rnd, "en") + "\n" + item, "en"))  # a leak
    rows += [(103, "1234 !?", "en"), (104, None, None), (105, "", "en"), (None, prose(rnd, "en"), "en")]
    WORDS["fr"] = [f"q{a}{b}eux" for a in "bcdfgh" for b in "aeiouy"]
    rows += [(i, prose(rnd, "fr") + "\n" + prose(rnd, "fr"), "fr") for i in range(200, 230)]
    thirds = "\n".join(prose(rnd, lang, n) for lang, n in (("en", 40), ("de", 35), ("fr", 25)))
    rows.append((300, thirds, "en"))  # no language has half of its words
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(zip([r[0] for r in rows], [r[1] for r in rows], strict=True))


def test_pipeline(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [name for name, _ in stages.STAGES] and len(stages.STAGES) == 5
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == columns
    everything = set(texts)
    assert kept["language"] == everything - {103, 104, 105}
    assert kept["lines"] == kept["language"] - {100}
    assert kept["near_duplicates"] == kept["lines"] - {101}
    assert kept["benchmark"] == kept["near_duplicates"] - {102}
    assert kept["tokens"] == kept["benchmark"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.where("doc_id IN (1, 7, 9)").collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in ran.collect()} == kept["tokens"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
