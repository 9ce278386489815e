"""Text functions, features and models."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import features, modeling
from caseloom.quality import report


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "column", "want"),
    [
        ("It&#39;s  hot\x00now ok", X.normalize, "It's hot now ok"),
        ("I can't and won't, they're", X.expand_contractions, "I cannot and will not, they are"),
        ("TL* stalls *AB UPDATED 01/02/2020. end", lambda c: X.squeeze(X.remove_markers(c)), "stalls end"),
        ("at 45 mph then about 70mph", X.max_mph, 70),
        ("no speed", X.max_mph, None),
        (None, X.max_mph, None),
        ("call 555-123-4567 or a.b@c.org", lambda c: X.squeeze(X.remove_personal(c)), "call or"),
        ("Text. Information redacted pursuant to the Freedom of Information Act (FOIA), 5 U.S.C.", lambda c: X.squeeze(X.cut_boilerplate(c)), "Text."),
        ("I filed a FOIA request. The brakes failed and the car burned.", X.cut_boilerplate, "I filed a FOIA request. The brakes failed and the car burned."),
        ("I filed a FOIA request. The brakes failed.", X.clean_for_topics, "i filed a foia request the brakes failed"),
        ("Stop don'ts now", X.expand_contractions, "Stop do nots now"),
        ("The contact owns a 2016 Example. It stalled at 60mph on the freeway. The manufacturer was notified of the failure. It got 20mpg.", X.clean_for_topics, "it stalled on the it got 20 mpg"),
        ("(555 main street, phone number 5) gears slip", X.clean_for_topics, "gears slip"),
        ("The contact stated that it stalled [XXX]. call 555-123-4567, case number 123456", X.severity_text, "that it stalled . call phone_token , case_id_token"),
        ("My car. Later the contact owns a truck and said that it burned. I sent a FOIA request. The end.", X.severity_text, "My car. Later the contact owns a truck and said that it burned. I sent a FOIA request. The end."),
        ("", X.severity_text, ""),
        (None, X.severity_text, ""),
        (None, X.clean_for_topics, None),
    ],
)
def test_functions(spark, text, column, want):
    assert one(spark, text, column) == want


def test_severity_text_against_brute_force(spark, sf):
    """The same steps with another engine over every narrative of the small table."""
    rows = spark.read.parquet(f"{sf}/odi_severity_cases.parquet").select("cdescr", X.severity_text(F.col("cdescr")).alias("got")).collect()
    for r in rows:
        t = re.sub(r"\s+", " ", r["cdescr"] or "").strip()
        for pattern, token in ((X.SEVERITY_MARK, " "), (X.SEVERITY_NOTICE, " "), (X.SEVERITY_OPENING, ""), *X.SEVERITY_TOKENS):
            t = re.sub(pattern, token, t, flags=re.A)
        assert r["got"] == re.sub(r"\s+", " ", t).strip()


def test_identifiers_with_quote_marks(spark):
    df = spark.createDataFrame([("a we\\Eird one", "we\\Eird")], "t string, a string")
    assert df.select(X.remove_identifiers(F.lower("t"), F.col("a"))).first()[0] == "a one"


def test_identifiers_and_context(spark):
    df = spark.createDataFrame([("my ford f-150 2017 stalled while driving at 60 mph on the highway", "FORD", "F-150", 2017), ("ok", None, "nan", None)], "t string, a string, b string, c int")
    rows = df.select(X.remove_identifiers(F.col("t"), F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert rows[0]["t"] == "my stalled while driving at 60 mph on the highway" and rows[1]["t"] == "ok"
    flags = X.context_flags(df, "t").collect()
    assert all(flags[0][f] for f in ("in_operation_flag", "highway_flag", "high_speed_flag", "critical_event_near_operation_flag"))
    assert not any(flags[1][f] for f in ("in_operation_flag", "highway_flag", "high_speed_flag", "critical_event_near_operation_flag"))


def test_lemmatizer_is_pluggable(spark):
    df = spark.createDataFrame([("Brakes",), (None,)], "t string")
    assert [r["l"] for r in X.lemmatize(df, "t", "l", lambda t: t.lower().rstrip("s")).collect()] == ["brake", None]


def test_tfidf_is_unit_length(spark):
    df = spark.createDataFrame([(1, "brake fails brake"), (2, "brake ok"), (3, "")], "k int, t string")
    w = modeling.tfidf(df, "k", modeling.word_grams(F.col("t"), ["ok"]))
    norms = {r["k"]: r["n"] for r in w.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert norms == {1: pytest.approx(1), 2: pytest.approx(1)}
    assert {r["term"] for r in w.filter("k = 1").collect()} == {"brake", "fails", "brake fails", "fails brake"}


def test_char_grams(spark):
    assert set(one(spark, "abc", lambda c: modeling.char_grams(c, 3, 4))) == {" ab", "abc", "bc ", " abc", "abc "}


def test_topics_separate(spark):
    docs = [(i, "brake pedal floor") if i % 2 else (i, "screen radio display") for i in range(40)]
    w = modeling.tfidf(spark.createDataFrame(docs, "k int, t string"), "k", modeling.word_grams(F.col("t"), two=False))
    topics, factor, vocabulary = modeling.nmf_topics(w, "k", 2, iterations=10)
    rows = modeling.topic_rows(topics, "k").collect()
    assert len({r["topic_id"] for r in rows if r["k"] % 2}) == 1 and len({r["topic_id"] for r in rows}) == 2
    assert modeling.pairwise_jaccard(modeling.top_terms(factor, vocabulary, 3)) == 0


def test_models(spark):
    rows = [(str(i), "a" if i % 2 else "b", float(i % 2) + i / 1000, i % 2 == 1) for i in range(200)]
    df = spark.createDataFrame(rows, "odino string, c string, x double, y boolean")
    frame = features.model_frame(df, ["c", "x", "c"], "y").withColumn("label", F.col("target").cast("double"))
    ready = modeling.structured_pipeline(["c"], ["x"]).fit(frame).transform(frame)
    model = modeling.fit_logistic(ready)
    assert model.transform(ready).filter("prediction = label").count() == 200
    slope, _ = modeling.platt(frame, "x", "label")
    assert slope > 0 and modeling.isotonic(frame, "x", "label").boundaries is not None
    labelled = ready.withColumn("labels", F.array(F.when(F.col("label") == 1, "odd").otherwise("even")))
    scored = modeling.score_one_vs_rest(labelled, modeling.fit_one_vs_rest(labelled, "labels", ["even", "odd"]), "odino")
    assert scored.first()["labels"] == ["even", "odd"] and scored.count() == 200


def test_splits_and_features(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 31), "TX", 2020), (dt.date(2025, 1, 1), "QQ", 2026), (None, None, None)], "ldate date, state string, yeartxt int")
    out = features.requested_features(df.withColumn("split", features.split_column(F.col("ldate"), "benchmark_v1")), ["vehicle_age_bucket", "state_region"]).collect()
    assert [(r["split"], r["vehicle_age_bucket"], r["state_region"]) for r in out] == [("train", "AGE_4_7", "SOUTH"), ("valid_2025", None, "UNKNOWN"), (None, None, "UNKNOWN")]
    with pytest.raises(ValueError, match="known"):
        features.split_policy("x")


def test_finite_guard(spark):
    with pytest.raises(ValueError, match="not finite"):
        report.finite(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])
