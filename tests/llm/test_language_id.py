import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.llm import language_id as L
from qanat.llm import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string"
EN = "the house and the garden with a small river near those old trees where children often play together"
DE = "das haus und der garten mit einem kleinen fluss neben den alten baeumen wo kinder oft zusammen spielen"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    samples = []
    for lang, text in (("de", DE), ("en", EN)):
        words = text.split()
        samples += [(lang, " ".join(rng.choice(words, 15))) for _ in range(60)]
    return L.train(samples)


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    factor, flow, start = rng.random((1, 4, 3)), rng.random((3, 3)), rng.random(3)
    total = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = start[path[0]] * factor[0, 0, path[0]]
        for i in range(1, 4):
            weight *= flow[path[i - 1], path[i]] * factor[0, i, path[i]]
        for i in range(4):
            total[i, path[i]] += weight
    p, _, _ = L.marginals(factor, np.array([4]), flow, start)
    assert np.allclose(p[0], total / total.sum(1, keepdims=True))


def test_words_of_both_languages_in_one_text_are_told_apart(model):
    words = "the garden with old trees kinder spielen oft neben dem fluss".split()
    scores = model.emissions(words)
    factor = np.exp(scores - scores.max(1, keepdims=True))[None]
    p, _, _ = L.marginals(factor, np.array([len(words)]), model.transition, model.start)
    assert [model.labels[i] for i in p[0].argmax(1)] == ["en"] * 5 + ["de"] * 6


def test_transitions_favour_staying(model):
    assert (np.diag(model.transition) > model.transition.min(1)).all()


def test_edges_of_the_input(spark, model):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 !? \n", None, "x"), (4, EN, "de", "x"), (4, EN, "de", "x"), (None, DE * 500, None, "x"), (6, "ж" * 100, None, "x")]
    found = L.label(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred == "en" and by[None].lang_pred == "de" and 0 <= by[6].score <= 1
    assert L.label(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert L.train(L.sample(spark.createDataFrame([], SCHEMA))) is None
    assert L.label(spark.createDataFrame(rows, SCHEMA), None).where("lang_pred = 'und'").count() == len(rows)


def test_long_texts_are_cut_into_sequences_not_dropped(model):
    whole = " ".join([EN] * 40) + " " + " ".join([DE] * 200)
    names, scores = L.predict(model, [whole])
    assert names == ["de"] and scores[0] == pytest.approx(200 / 240, abs=0.05)


def test_held_out_accuracy(spark):
    found = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.count() > 100 and found.count() == 1000
    assert held.where("lang = lang_pred").count() / held.count() > 0.98
    expected = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).count()
    assert held.count() == expected
