"""Packed documents x terms: weights against SQL, topics against updates of single documents."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import matrix, modeling
from caseloom.plans import relational

TEXTS = ["brake fails at speed", "brake pedal soft brake", None, "", "fails again and again", "speed brake fails pedal again", "again brake speed soft", "pedal fails brake speed", "soft pedal again brake fails", "speed"]


@pytest.mark.parametrize("most", [modeling.PACKED_MOST, 0])
@pytest.mark.parametrize("keys", ["unique", "null", "twice"])
def test_tfidf_terms_equals_sql_for_any_keys(spark, tmp_path, monkeypatch, keys, most):
    """Documents without a key are one document, as in SQL; a vocabulary too large to travel gives the same."""
    monkeypatch.setattr(modeling, "PACKED_MOST", most)
    key = {"unique": str, "null": lambda i: None if i in (1, 5, 8) else str(i), "twice": lambda i: str(i % 17)}[keys]
    path = str(tmp_path / "odi_severity_cases.parquet")
    spark.createDataFrame([(key(i), t) for i, t in enumerate(TEXTS * 2)], "odino string, cdescr string").coalesce(1).write.parquet(path)
    got = sorted(map(tuple, relational.QUERIES["tfidf_terms"](spark, str(tmp_path)).select("term", "docs", "total_weight").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW odi_severity_cases AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(f"SELECT term, docs, total_weight FROM ({relational.SQL['tfidf_terms']})").fetchall())
    assert want and [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-5)


@pytest.mark.parametrize("most", [modeling.PACKED_MOST, 0])
def test_weights_of_documents(spark, monkeypatch, most):
    monkeypatch.setattr(modeling, "PACKED_MOST", most)
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (2, "b1 c1"), (None, "c1")], "k int, t string")
    rows = {(r["k"], r["term"]): r["weight"] for r in modeling.tfidf(docs, "k", F.split("t", " "), sublinear=False).collect()}
    assert set(rows) == {(1, "a1"), (1, "b1"), (2, "b1"), (2, "c1"), (None, "c1")} and rows[None, "c1"] == pytest.approx(1)
    assert rows[2, "b1"] == pytest.approx(rows[2, "c1"]) and rows[1, "a1"] > 2 * rows[1, "b1"]


# --- topics ---


def test_products_of_uneven_rows():
    rng = np.random.default_rng(1)
    size = np.concatenate([rng.integers(0, 9, 400), [0, 700, 20_000], rng.integers(20, 90, 300)])
    ptr = np.concatenate([[0], np.cumsum(size)])
    idx, val, dense = rng.integers(0, 500, ptr[-1]), rng.random(ptr[-1]), rng.random((500, 7))
    want = [val[i:j] @ dense[idx[i:j]] if j > i else np.zeros(7) for i, j in zip(ptr[:-1], ptr[1:])]
    assert matrix.product(ptr, idx, val, dense) == pytest.approx(np.array(want))


def test_packed_topics_equal_updates_of_single_documents(spark):
    """Blocks of the fitted documents give the factor that one document at a time gives, and every document its weights."""
    rng = np.random.default_rng(2)
    docs = [(f"k{i:03d}", " ".join(f"w{min(x, 40)}" for x in rng.geometric(0.08, rng.integers(1, 30))), i % 3 > 0) for i in range(90)] + [("none", "", True)]
    df = spark.createDataFrame(docs, "k string, t string, f boolean").repartition(3)
    packed = modeling.tfidf_matrix(df, "k", modeling.word_grams(F.col("t"), two=False), least_df=3, most_share=0.9, fitted=F.col("f"), pairs=True)
    rows = packed.weights().collect()
    got, factor, vocabulary = modeling.nmf_topics(packed, "k", 4, iterations=3)
    assert any(" " in t for t in vocabulary) and vocabulary == sorted({r["term"] for r in rows})
    place, x = {t: i for i, t in enumerate(vocabulary)}, {}
    for r in rows:
        x.setdefault(r["k"], np.zeros(len(vocabulary)))[place[r["term"]]] = r["weight"]
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in x.values()) and "none" not in x

    def solve(v, h):
        w = np.full(4, 0.1)
        for _ in range(25):
            w *= (h @ v) / np.maximum(h @ h.T @ w, 1e-12)
        return w

    h = np.random.default_rng(7).random((4, len(vocabulary))) + 1e-3
    for _ in range(3):
        w = {k: solve(x[k], h) for k, _, fitted in docs if fitted and k in x}
        a, b = sum(np.outer(v, v) for v in w.values()), sum(np.outer(v, x[k]) for k, v in w.items())
        for _ in range(10):
            h *= b / np.maximum(a @ h, 1e-12)
        h = np.maximum(h, 1e-12)
    assert factor == pytest.approx(h)
    got = {r["k"]: r["topic_weights"] for r in got.collect()}
    assert set(got) == set(x) and all(got[k] == pytest.approx(solve(v, h)) for k, v in x.items())
