"""License scans on wording that the training has not seen, on wrapped texts, on other licences, and with a saved model."""

import textwrap

import corpus
import pytest
from unseen import UNSEEN

from colloquy.llm import licenses as L
from colloquy.llm import license_texts

#: Phrases that the training does not have.
PHRASES = ("You may use this under {}.", "{} applies to everything in this folder.", "Published with {} by the team.", "The sources come with {} and no warranty.", "Copies fall under {} as well.", "We chose {} for this module.")


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def found(spark, model, rows):
    return L.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()


def test_unseen_phrases(spark, model):
    rows, want = [], {}
    for family in L.FAMILIES:
        for title in L.TITLES[family]:
            for phrase in PHRASES:
                want[len(rows)] = family
                rows.append((len(rows), phrase.format(title)))
    got = {r.doc_id: r for r in found(spark, model, rows)}
    assert sum(i in got and got[i].family == f and got[i].confirmed for i, f in want.items()) >= 0.95 * len(want)
    assert [(rows[i][1], r.family) for i, r in got.items() if r.confirmed and r.family != want[i]] == []


def test_unseen_paragraphs(spark, model):
    rows, want = [], {}
    for family, texts in UNSEEN.items():
        for text in texts:
            want[len(rows)] = family
            rows.append((len(rows), text))
    got = {r.doc_id: r for r in found(spark, model, rows)}
    known = [i for i, f in want.items() if f]
    assert sum(i in got and got[i].family == want[i] for i in known) >= 0.9 * len(known)
    assert [(rows[i][1], r.family) for i, r in got.items() if r.confirmed and r.family != want[i]] == []
    assert sum(i not in got for i, f in want.items() if f is None) >= 0.9 * sum(f is None for f in want.values())


def test_licences_outside_the_families_are_unknown(spark, model):
    rows = [(i, t) for i, t in enumerate(t for ts in license_texts.OTHERS.values() for t in ts)]
    rows += [(len(rows) + i, L.PHRASES[0].format(t)) for i, t in enumerate(license_texts.OTHER_TITLES)]
    assert [(r.family, rows[r.doc_id][1]) for r in found(spark, model, rows) if r.confirmed] == []


def test_whole_texts_and_wrapped_ones(spark, model):
    rows, want = [], {}
    for family, texts in license_texts.FAMILIES.items():
        for text in texts:
            for shown in (text, *("\n".join(textwrap.wrap(text, w)) for w in (64, 78) if len(text.split()) > 20)):
                want[len(rows)] = family
                rows.append((len(rows), shown))
    got = found(spark, model, rows)
    right = {r.doc_id for r in got if r.confirmed and r.family == want[r.doc_id]}
    # some wrapped lines stand word for word in the texts of two families
    line = lambda r: rows[r.doc_id][1].split("\n")[r.paragraph]
    wrong = [(r.family, want[r.doc_id], line(r)) for r in got if r.confirmed and r.family != want[r.doc_id] and not any(line(r) in t for t in license_texts.FAMILIES[r.family])]
    assert len(right) >= 0.9 * len(want) and wrong == []


def test_ordinary_paragraphs_are_unknown(spark, model):
    rows = [(i, corpus.prose(400 + i, 30)) for i in range(200)] + [(900, "the public version of the story, under the terms of the deal"), (901, "this software is free of charge for schools"), (902, "a license to drive"), (903, None), (904, "")]
    assert [r for r in found(spark, model, rows) if r.confirmed] == []


def test_a_saved_model_gives_the_same(spark, model, tmp_path):
    L.save(model, spark, str(tmp_path / "model"))
    again = L.load(spark, str(tmp_path / "model"))
    assert again == model and 0.5 <= model.limit < 1


def test_words_of_templates_are_those_of_texts(spark):
    texts = [t.text for t in L.templates()][::17] + ["A.b-C. (x) 1.0-", "--", "É é"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", L.words(L.F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: L._tokens(t) for i, t in enumerate(texts)}


def test_an_empty_table_leaves_the_licences_to_train_on(spark):
    model = L.train(corpus.empty(spark).select("doc_id", "text"))
    assert L.classify(corpus.empty(spark).select("doc_id", "text"), model).count() == 0
    assert [r.family for r in found(spark, model, [(1, "Released under the MIT License.")])] == ["MIT"]
