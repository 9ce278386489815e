"""Reading level: held-out accuracy, and a bounded graph."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import reading

WORDS = {
    "plain": "car stop hit door fast loud kid road home help bad hot wet key seat dog run fell broke cold".split(),
    "middle": "warning dealer repaired replaced mileage highway engine service noise driver morning warranty problem weather traffic window passenger invoice brake pedal".split(),
    "demanding": "metallographic dispositive deterioration calibration instrumentation propagating certification subsequent discontinuity telemetry promulgated methodology embrittlement attenuation causation representative circumferential preliminary indeterminate supplementary".split(),
}


def corpus(rng, n):
    rows = []
    for i in range(n):
        band = rng.choice(list(WORDS))
        words = []
        while len(words) < 80:
            source = band if rng.random() < 0.75 else rng.choice(list(WORDS))
            words += [rng.choice(WORDS[source] + ["the", "and", "of"]) for _ in range(10)]
        rows.append((i, " ".join(words), "en", band))
    return rows


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    rows = corpus(rng, 300)
    docs = spark.createDataFrame([(i, t, la) for i, t, la, _ in rows] + [(900, "short text", "en"), (901, None, "en"), (902, rows[0][1], "de"), (903, "1 2 3 " * 60, "en")], "doc_id long, text string, lang string")
    known = [(i, b if rng.random() > 0.05 else "plain") for i, _, _, b in rows[:90]]
    labels = spark.createDataFrame(known + known[:10] + [(77777, "plain"), (None, "plain")], "doc_id long, band string")
    got = {r["doc_id"]: r["band"] for r in reading.reading_levels(docs, "doc_id", "text", "lang", "en", labels, "doc_id", "band").collect()}
    assert set(got) == {i for i, *_ in rows} | {903} and got[903] == "middle"
    unseen = rows[90:]
    assert sum(got[i] == b for i, _, _, b in unseen) / len(unseen) > 0.9


def levels(spark, rows, labels, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: (round(r["difficulty"], 6), r["band"]) for r in reading.reading_levels(docs, "doc_id", "text", "lang", "en", spark.createDataFrame(labels, "doc_id long, band string"), "doc_id", "band", **more).collect()}


def test_words_outside_the_head_keep_their_values(spark, monkeypatch):
    """Vectors for all words, for some, and for one give the same levels; so do many small blocks."""
    rng = random.Random(8)
    rows = [(i, t, la) for i, t, la, _ in corpus(rng, 60)]
    labels = [(i, b) for i, _, _, b in corpus(random.Random(8), 60)][:25]
    whole = levels(spark, rows, labels)
    monkeypatch.setattr(reading, "BLOCK_WORDS", 300)
    assert levels(spark, rows, labels) == whole
    assert levels(spark, rows, labels, head_most=20) == whole
    assert levels(spark, rows, labels, head_most=1) == whole


def test_harmonic_values_against_brute_force(spark):
    """Converged values solve the harmonic equations on a small graph."""
    rows = [(1, "a b c " * 20, "en"), (2, "c d e " * 20, "en"), (3, "a c e f " * 15, "en"), (4, "d e f hapax " + "f " * 50, "en")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc long, text string").withColumn("grade", F.when(F.col("doc") == 1, 0.0).when(F.col("doc") == 2, 1.0))
    graph = reading.build_graph(reading.materialize(reading.word_blocks(docs, 1), "t"))
    value, tail, rounds, moved = reading.propagate(graph)
    assert tail is None and moved < reading.CHANGE_LEAST and rounds > 1 and graph.documents == 4 and len(value) == 5
    counts = {i: {w: t.split().count(w) for w in set(t.split())} for i, t, _ in rows}
    names = [w for _, w in sorted((-sum(w in c for c in counts.values()), w) for w in "acdef")]
    idf = {w: np.log(4 / sum(w in c for c in counts.values())) for w in names}
    g, score = dict.fromkeys(names, 0.5), {1: 0.0, 2: 1.0}
    for _ in range(500):
        for i in (3, 4):
            score[i] = sum(counts[i].get(w, 0) * idf[w] * g[w] for w in names) / sum(counts[i].get(w, 0) * idf[w] for w in names)
        g = {w: sum(c.get(w, 0) * score[i] for i, c in counts.items()) / sum(c.get(w, 0) for c in counts.values()) for w in names}
    assert np.abs(value - [g[w] for w in names]).max() < 0.02


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, band string")
    assert [r["band"] for r in reading.reading_levels(docs, "doc_id", "text", "lang", "en", labels, "doc_id", "band").collect()] == ["middle"]
    assert reading.reading_levels(docs.limit(0), "doc_id", "text", "lang", "en", labels, "doc_id", "band").count() == 0


def test_grades(spark):
    labels = spark.createDataFrame([(1, "plain"), (1, "plain"), (1, "demanding"), (2, "plain"), (2, "middle"), (3, "odd")], "doc_id long, band string")
    assert {r["doc_id"]: r["grade"] for r in reading.graded(labels, "doc_id", "band").collect()} == {1: 0.0, 2: 0.5}


def test_cut():
    low, high = np.zeros(reading.BINS), np.zeros(reading.BINS)
    low[100:300], high[700:900] = 1, 1
    assert 0.14 < reading.best_cut(low, high) < 0.36
    assert reading.best_cut(low, np.zeros(reading.BINS)) == pytest.approx(0.5)
