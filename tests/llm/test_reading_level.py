import random

import numpy as np
import pytest

from siftara.llm import reading_level as R
from siftara.llm.boosting import BoostedTrees, isotonic
from siftara.llm.prose import prose_blocks, sentences

EASY = "cat dog run red sun map box cup hat pen".split()
HARD = "interpretation characteristic representation specification reproducibility generalization".split()


def document(rng, hard):
    out = []
    for _ in range(8):
        n = rng.randrange(22, 30) if hard else rng.randrange(4, 9)
        s = [rng.choice(HARD) if hard and rng.random() < 0.45 else rng.choice(EASY) for _ in range(n)]
        out.append(s[0].capitalize() + " " + " ".join(s[1:]) + ".")
    return " ".join(out)


def test_sentences():
    text = "# Title here\n\nOne two cf. three. Is v2.1 new?\nA line\ngoes on\nAnother line.\n\n- a list. With. Points.\n```\ncode. Here.\n```\n2026-01-01T10:00 INFO x. y.\n<loop>\n[Plan 3]\n> Quoted words\n> go on! A&nbsp;<b>bold</b> end"
    assert [" ".join(s) for s in sentences(text)] == ["One two cf. three.", "Is v2.1 new?", "A line goes on", "Another line.", "Quoted words go on!", "A bold end"]
    assert sentences(None) == [] and sentences("```\nx = 1\n```") == [] and prose_blocks("inter-\npretation of") == ["interpretation of"]


def test_trees_fit_and_calibration_rises():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + (x[:, 1] > 0.3) * (x[:, 0] > 0.5)
    model = BoostedTrees().fit(x[:1000], y[:1000])
    assert np.abs(model.predict(x[1000:]) - y[1000:]).mean() < 0.1
    knots, values = isotonic(rng.random(200), rng.random(200))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert isotonic(np.array([1.0, 2.0, 3.0]), np.array([1.0, 3.0, 2.0]))[1].tolist() == [1.0, 2.5]
    assert BoostedTrees().fit(x[:5], y[:5]).predict(x[:2]) == pytest.approx([y[:5].mean()] * 2)


def frames(spark, labelled=120):
    rng = random.Random(2)
    docs = [(i, document(rng, i % 3 == 0), f"s{i % 11}", "extra") for i in range(300)] + [(900, None, "s", "e"), (901, "", None, "e"), (902, "```\nx\n```", "s", "e")]
    labels = [(i, max(1, min(5, (5 if i % 3 == 0 else 2) + rng.choice([0, 0, 0, -1, 1]))), "r") for i in range(labelled)] + [(1, None, "r"), (None, 3, "r"), (12345, 3, "r")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, grade string"), spark.createDataFrame(labels, "doc_id long, level int, rater string")


def test_levels(spark):
    docs, labels = frames(spark)
    model = R.train(docs, labels)
    errors = [abs(r - g) for _, r, g in model.held_out]
    assert len(errors) == 120 and np.mean(errors) < 0.6
    graded = R.grade_documents(docs, model, "doc_id")
    assert {r["doc_id"] for r in graded.where("demanding").collect()} == {i for i in range(300) if i % 3 == 0}
    assert {r["doc_id"] for r in graded.where("grade is null").collect()} == {900, 901, 902}
    again = {r["doc_id"]: r["grade"] for r in R.grade_documents(docs.repartition(5), R.train(docs.repartition(3), labels.repartition(2)), "doc_id").collect()}
    assert again == pytest.approx({r["doc_id"]: r["grade"] for r in graded.collect()}, nan_ok=True)
    v = R.validation(docs, labels)
    assert sum(r["rated"] for r in v.collect()) == 120


def test_no_labels(spark):
    docs, labels = frames(spark, 5)
    assert R.train(docs, labels) is None
    assert R.grade_documents(docs, None, "doc_id").where("grade is not null").count() == 0
    assert R.grade_documents(docs.limit(0), None, "doc_id").collect() == [] and R.validation(docs, labels.limit(0)).collect() == []


@pytest.mark.parametrize("labelled", [7, 19])
def test_few_labels_lose_no_demanding_document(spark, labelled):
    docs, labels = frames(spark, labelled)
    model = R.train(docs, labels)
    graded = R.grade_documents(docs, model, "doc_id")
    assert {r["doc_id"] for r in graded.where("demanding").collect()} == {i for i in range(300) if i % 3 == 0}
    grades = {r["doc_id"]: r["grade"] for r in graded.where("grade is not null").collect()}
    assert len(grades) == 300 and all(1 <= g <= 5 for g in grades.values()) and len(model.held_out) == labelled
    assert np.mean([grades[i] for i in range(0, 300, 3)]) > np.mean([grades[i] for i in range(1, 300, 3)]) + 1


def test_too_few_labels_are_said(spark):
    docs, labels = frames(spark, 5)
    with pytest.warns(UserWarning, match="5 rated documents"):
        model = R.train(docs, labels)
    assert model is None and R.grade_documents(docs, model, "doc_id").where("demanding").count() == 0


def test_border_lies_where_held_out_grades_part():
    rng = np.random.default_rng(3)
    y = np.repeat([2.0, 5.0], 200)
    grades = np.where(y > 3, rng.uniform(3.3, 5, 400), rng.uniform(1, 3.1, 400))
    assert 3.1 <= R.border(grades, y) <= 3.31 and R.border(np.where(y > 3, 4.5, 1.5), y) == 3.5
    assert R.border(np.array([2.0]), np.array([2.0])) == 3.5
