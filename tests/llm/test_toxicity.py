"""Toxicity on held-out documents, offending sentences, and edges."""

import math

import numpy as np
import pytest

from pagemill.llm import toxicity

BAD = ("idiot", "scum", "verräterpack")


@pytest.fixture(scope="module")
def made():
    """Documents of plain sentences; one sentence of a fifth of them holds a bad word, 3 % of labels are wrong."""
    draw = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "ven", "gru") for b in ("n", "sta", "ker", "vö", "lli", "bend")]
    rows = []
    for k in range(900):
        sentences = [" ".join(draw.choice(plain, draw.integers(4, 12))) for _ in range(draw.integers(1, 9))]
        bad = draw.random() < 0.2
        if bad:
            at = draw.integers(len(sentences))
            sentences[at] += " " + str(draw.choice(BAD)) + str(draw.choice(["", "en", "s"])) + " ja"
        rows.append((k, ". ".join(sentences) + ".", int(bad ^ (draw.random() < 0.03)), bad))
    return rows


def test_held_out_documents_and_their_sentences(spark, made):
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in made], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < model.leak < 0.1
    out = {r["doc_id"] for r in docs.filter(toxicity.held_out()).collect()}
    assert 120 < len(out) < 240
    rows = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    for k, text, _, bad in made:
        if k in out:
            assert (rows[k]["score"] >= 0.5) == bad, text
            spots = [text[s["start"] : s["end"]] for s in rows[k]["offending"]]
            assert bool(spots) == bad
            assert all(any(b in s for b in BAD) for s in spots)


def test_held_out_labels_change_nothing(spark, made):
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in made], "doc_id long, toxic int")
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    first, second = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert first.weights.keys() == second.weights.keys()
    assert math.isclose(first.bias, second.bias, rel_tol=1e-6)


def test_noisy_or_is_the_stated_formula(spark):
    model = toxicity.Model({"bad$": 3.0, "worse": 2.0}, -1.0, 0.2)
    texts = ["Bad day! Worsen? Fine\n...\n ok", "", None, "bad bad", "x" * 200_000 + " bad."]
    rows = toxicity.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).orderBy("id").collect()
    p = lambda z: 1 / (1 + math.exp(-z))
    expect = [1 - 0.8 * (1 - p(2)) * (1 - p(1)) * (1 - p(-1)) ** 2, 0.2, 0.2, 1 - 0.8 * (1 - p(2)), 1 - 0.8 * (1 - p(2))]
    assert [r["score"] for r in rows] == pytest.approx(expect)
    assert [[(s["start"], s["end"]) for s in r["offending"]] for r in rows] == [[(0, 7), (8, 15)], [], [], [(0, 7)], [(0, 200_004)]]


def test_nulls_repeats_clashing_columns_and_missing_labels(spark):
    schema = "doc_id long, text string, toxic string, id int, score int, feature int"
    docs = spark.createDataFrame([(1, "you scum", "q", 1, 1, 1), (None,) * 6, (1, "you scum", "q", 1, 1, 1), (2, "", "q", 1, 1, 1)], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0), (9, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 4
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    alone = toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 1")))
    assert {r["score"] for r in alone.collect()} == {1.0}
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.0}
