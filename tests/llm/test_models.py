"""Language ID, toxicity, quality rules, decontamination and archives."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.llm import decontaminate, langid, quality, toxicity, warc
from signalspark.llm.kernel import Words, utf8

VOCABULARY = {
    "aa": "the and with that from this have been there which would their".split(),
    "bb": "der und die nicht ein eine ist auch sich über für können".split(),
    "cc": "les des une dans pour que avec été être où là très".split(),
}


def sentence(rnd, lang, n=40):
    return " ".join(rnd.choice(VOCABULARY[lang]) for _ in range(n))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")


def test_language_of_single_and_mixed_texts(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang), lang, "") for i, lang in enumerate(sorted(VOCABULARY) * 20)]
    docs = labelled(spark, rows)
    held_out = langid.remainder("doc_id", 3) == 1
    model = langid.learn(docs.where(~held_out))
    assert model.languages == ["aa", "bb", "cc"]
    found = langid.identify(docs.where(held_out), model, keep=["doc_id", "lang"]).collect()
    assert len(found) > 10 and all(r.lang == r.lang_pred and r.score > 0.9 and len(r.languages) == 1 for r in found)
    mixed = sentence(rnd, "aa", 70) + " " + sentence(rnd, "bb", 30)
    odd = [(1, mixed, None, ""), (2, None, "aa", ""), (3, "", "aa", ""), (4, "123 !? 42", None, ""), (5, "日本", None, "")]
    got = {r.doc_id: r for r in langid.identify(labelled(spark, odd), model).collect()}
    assert got[1].languages == ["aa", "bb"] and got[1].shares[0] == pytest.approx(0.7, abs=0.1)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert got[5].lang_pred in model.languages


def test_language_without_anything_to_learn(spark):
    model = langid.learn(labelled(spark, [(1, "a b", None, ""), (2, None, "aa", "")]))
    assert model.languages == []
    assert langid.identify(labelled(spark, [(1, "a b", "aa", "")]), model).first().lang_pred == "und"
    assert langid.identify(labelled(spark, []), model).count() == 0


def test_more_languages_than_the_bound_raise(spark):
    rows = labelled(spark, [(i, sentence(random.Random(i), lang), lang, "") for i, lang in enumerate(VOCABULARY)])
    assert langid.learn(rows, max_languages=3).languages == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.learn(rows, max_languages=2)


def test_remainder_equals_crc32_of_the_id(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 42, 10**12)], "doc_id bigint")
    got = {r[0]: r[1] for r in ids.select("doc_id", langid.remainder("doc_id", 7)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in got}


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    bad = ["dreadfool", "slimehead", "rotbrain"]
    rows = []
    for i in range(n):
        words = sentence(rnd, "aa", 60).split()
        toxic = int(i % 4 == 0)
        if toxic:
            words[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows = toxic_rows(600, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 0), (9999, 1), (5, None)], "doc_id bigint, toxic int")
    held_out = langid.remainder("doc_id", 4) == 2
    model = toxicity.learn(docs, labels.where(~held_out), toxic_rows=100, clean_rows=200)
    got = {r.doc_id: r for r in toxicity.score(docs.where(held_out), model).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([got[i].predicted == truth[i] for i in got]) > 0.95
    odd = ["the and slimeheads with", "the and that", None, "", "!!!", "this rotbraiin have " + "the " * 5000]
    found = toxicity.score(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string"), model)
    score = [r.score for r in sorted(found.collect())]
    assert score[0] > 0.3 > score[1] and score[2:4] == [0, 0] and score[4] < 0.3 < score[5]


def test_toxicity_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    for rows in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        found = toxicity.score(docs, model).first()
        assert 0 <= found.score <= 1 and found.predicted == int(found.score >= 0.3)


def test_words_and_lines_of_blocks():
    import pyarrow as pa

    texts = ["a b\n\nc", "", "\n", "é  x\n", "one"]
    words = Words(*utf8(pa.array([*texts, None])), lines=True)
    lines = [(i, j, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in enumerate([*texts, ""]) for j, x in enumerate(t.split("\n"))]
    assert list(zip(words.row_text, words.row_line, np.diff(words.bounds), strict=True)) == lines


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_measures_equal_counting_by_hand(spark):
    rnd = random.Random(3)
    texts = [None, "", " ", "a", "a a a a", "a b c a b c", "x\nx\n x\n\n \nx", "#*$ %& é日本 |<>", "a\x1cb\xa0c d"]
    texts += [" ".join(rnd.choice("abc") + rnd.choice(["", "\n", "\t"]) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "h", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_words string")
    for r in quality.measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_by_hand(texts[r.key])


def test_host_verdicts_shrink_small_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, f"host{i % 10}") for i in range(300)]
    rows += [(1000 + i, "short", "bad") for i in range(40)] + [(2000, good, "bad"), (3000, "short", "tiny"), (3001, good, "tiny")]
    rows += [(4000, good, None), (4000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.key: r for r in quality.judge(docs).collect()}
    assert not found[2000].kept and found[2000].host_failed and not found[2000].base_failed
    assert found[3001].kept and found[3000].base_failed and found[0].kept and found[4000].kept
    assert quality.judge(docs).count() == len(rows)
    assert quality.judge(docs.limit(0)).count() == 0


QUESTION = "A train leaves Paris at noon and, Anna says, travels 120 km in 2 hours before it stops again for 15 minutes at the border"


def leaks(spark, texts, items=((0, QUESTION),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in decontaminate.find_leaks(docs, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_decontamination_finds_new_values_and_checks_them(spark):
    asked = QUESTION.replace("120 km", "300 miles").replace("2 hours", "5 hours").replace("Anna", "Boris")
    texts = [
        f"Before. {QUESTION}. After.", QUESTION.upper(), f"x {asked} y", "nothing of the kind stands in this text at all",
        None, "", "the " * 5000 + QUESTION, QUESTION[:30],
    ]
    assert leaks(spark, texts) == {0, 1, 2, 6}


def test_decontamination_rejects_values_that_do_not_map(spark):
    item = "take 7 apples from the basket and put 7 apples into the bag then count 7 apples again"
    same = item.replace("7", "9")
    mixed = "take 1 apples from the basket and put 2 apples into the bag then count 3 apples again"
    assert leaks(spark, [same, mixed, item], [(5, item)]) == {0, 2}


def test_decontamination_keeps_windows_without_the_conflicting_value(spark):
    item = "take 7 apples from the basket and put 7 apples into the bag then count 7 apples again"
    changed = item.replace("count 7", "count 8")
    tail = "then walk along the river until the old stone bridge comes into sight and rest there"
    other = f"take 1 apples and put 2 apples away {tail}"
    assert leaks(spark, [changed, other, changed.upper()], [(5, item)]) == {0, 2}
    assert leaks(spark, [other], [(5, f"take 7 apples and put 7 apples away {tail}")]) == {0}
    two = "put 3 apples and then 5 pears into a box of wood or glass"
    assert leaks(spark, [two.replace("3", "4").replace("5", "4"), two.replace("3", "8")], [(5, two)]) == {1}


def test_decontamination_finds_names_wherever_they_stand(spark):
    item = "Tom has 4 pens. Ann has 7 pens. Sue has 9 pens. Who has the most pens?"
    asked = "Bob has 5 pens. Eve has 8 pens. Kim has 6 pens. Who has the most pens?"
    quoted = asked.replace("Eve", "“Eve”").replace("Kim", "(Kim)")
    texts = [asked, asked.replace(". ", ".\n"), asked.replace(" ", "  "), quoted, item.lower(), item.upper(), f"So: {asked}"]
    texts += [asked.replace("Kim", "Bob")[:47], "Who has the most pens?"]
    assert leaks(spark, texts, [(0, item)]) == {0, 1, 2, 3, 4, 5, 6}
    wrapped = QUESTION.replace("Anna", "Boris").replace(" ", "\n").replace("120", "77")
    assert leaks(spark, [wrapped, QUESTION.lower().replace(" ", "\t ")]) == {0, 1}


def test_decontamination_finds_a_passage_of_a_long_item(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)]
    texts = [" ".join(["x", *words[200 : 200 + n], "y"]) for n in (100, 13, 12)]
    texts.append(" ".join([*words[10:19], "x", *words[30:39], "y", *words[50:59]]))
    assert leaks(spark, texts, [(0, " ".join(words))]) == {0, 1}
    assert leaks(spark, [" ".join(words[20:35])], [(0, " ".join(words[:59]))]) == {0}


def test_decontamination_of_odd_tables(spark):
    numbers = "1 2 3 4 5 6 7 8 9 10"
    short = "five words are just enough"
    items = [(0, numbers), (1, short), (2, "too short"), (3, None), (3, ""), (1, short), (None, QUESTION)]
    texts = [numbers, "11 12 13 14 15 16 17 18 19 20", f"so {short} here", "too short", QUESTION]
    assert leaks(spark, texts, items) == {0, 2, 4}
    assert leaks(spark, texts, []) == set()
    assert leaks(spark, [], items) == set()
    kinds = "doc_id bigint, text string, text_hash string, item_id bigint"
    docs = spark.createDataFrame([(1, QUESTION, "a", 4), (None, QUESTION, "b", 5), (2, "fine", "c", 6), (2, "fine", "c", 6), (3, None, None, None)], kinds)
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3"]


def test_native_plans_have_no_python(spark):
    docs = spark.createDataFrame([(1, QUESTION, "h")], "doc_id bigint, text string, source string")
    items = spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string")
    for frame in (quality.judge(docs), quality.measures(docs), decontaminate.find_leaks(docs, items)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow|ArrowEval", plan)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, html string, payload_bytes bigint")


def test_archive_round_trip(spark):
    rnd = random.Random(6)
    long = [f"{c}é" * 700 for c in "abc"]
    rows = [(i, f"http://x/{i}", rnd.choice([*long, f"own {i} " * 300, "short", "", None])) for i in range(200)]
    rows += [(None, None, long[0]), (77777, "http://y\r\nX: 1", long[0]), (5, "again", long[1]), (5, "again", long[1])]
    archive = warc.write(pages(spark, rows), shard_bytes=50_000, roll_bytes=2_000, sample=4000)
    assert archive.manifest.select("shard").distinct().count() > 3 and archive.manifest.where("part > 0").count() > 0
    found = warc.read(spark, archive).collect()
    assert len(found) == len(rows)
    last, by_payload = {}, {}
    for i, _, t in rows:
        by_payload.setdefault(t or "", []).append(i)
    for t, ids in by_payload.items():
        last[t] = max(ids, key=lambda i: -1 if i is None else i)
    sha = {hashlib.sha1(t.encode()).hexdigest(): t for t in by_payload}
    responses = []
    for r in found:
        text = sha[r.payload_digest]
        size = len(text.encode())
        assert r.payload_bytes == size
        if r.record_type == "response":
            assert r.payload.decode() == text and r.refers_to is None
            if size >= 1000:
                responses.append(text)
                assert r.page_id == last[text]
        else:
            assert size >= 1000 and r.payload is None and r.refers_to == last[text]
    assert sorted(responses) == sorted(t for t in by_payload if len(t.encode()) >= 1000)


def test_archive_is_the_same_in_every_run(spark):
    rows = [(i, f"u{i}", f"text {i % 7} " * 200) for i in range(60)]
    hashes = []
    for parts in (1, 5):
        archive = warc.write(pages(spark, rows).repartition(parts), shard_bytes=20_000, roll_bytes=1_000)
        hashes.append(sorted((r.name, r.sha256) for r in archive.manifest.collect()))
    assert hashes[0] == hashes[1] and len(hashes[0]) > 2


def test_archive_of_an_empty_table(spark):
    archive = warc.write(pages(spark, []))
    assert warc.read(spark, archive).count() == 0


def test_clashing_columns_pass_through_the_stages(spark):
    from signalspark.llm import stages

    rows = [(i, sentence(random.Random(i), "aa"), "aa", "s", 1, "x", 2.0) for i in range(12)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double"
    docs = spark.createDataFrame(rows, kinds)
    found = stages.identify_language(spark, docs, "")
    assert found.columns == docs.columns and found.where(F.col("score") == 2.0).count() == 12


def test_a_kept_text_is_sent_to_python_once(documents):
    from signalspark.llm import langid

    docs = documents([(1, "the house"), (2, None)])
    found = langid.identify(docs, langid.learn(docs), keep=["doc_id", "text"])
    sent = found._jdf.queryExecution().analyzed().children().head().output().size()
    assert sent == 2
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "the house"), (2, None)]
