"""End-to-end runs on the smallest tables, and the report and selection operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import reports, selection
from caseloom.plans import pipelines, relational
from caseloom.session import load_table


def test_preprocess_and_early_warning(spark, sf, tmp_path):
    tables = pipelines.preprocess(spark, load_table(spark, sf, "complaints"), str(tmp_path / "pre"))
    assert tables["multi"].count() == tables["multi"].select("odino").distinct().count() > 0
    out = pipelines.early_warning(spark, tables["multi"], tables["text"], str(tmp_path / "warn"), topics=3, least_df=2, iterations=3)
    assert out["cache"].filter("topic_text = ''").count() == 0
    assert out["rows"].filter("topic_strength < 0.2").count() == 0
    assert {"watchlist_score", "signal_tier", "month_rank"} <= set(out["watchlist"].columns)


def test_severity_benchmark(spark, sf):
    scores, metrics = pipelines.severity_benchmark(load_table(spark, "/root/testdata/sf0.01", "odi_severity_cases"), ["state", "fuel_type"], ["miles", "veh_speed"])
    assert {r["split"] for r in metrics.collect()} == {"valid_2025", "holdout_2026"}
    assert scores.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_bands_number_every_row_once(spark):
    rng = random.Random(0)
    rows = [("a", f"{i:03d}", rng.random() < 0.2, round(rng.random(), 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k string, truth boolean, score double")
    got = {r["k"]: r["percent_rank"] for r in reports.urgency_bands(df, "score", "truth", "k", ["g"]).collect()}
    want = {k: (i + 1) / 200 for i, (_, k) in enumerate(sorted((-s, k) for _, k, _, s in rows))}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_seed_summary_and_rows(spark):
    df = spark.createDataFrame([("m", "v", 0.5), ("m", "v", 0.7)], "model string, split string, f1 double")
    row = reports.seed_summary(df, ["model"], ["f1"]).first()
    assert (row["f1_mean"], row["f1_std"], row["f1_median"]) == (pytest.approx(0.6), pytest.approx(0.1), pytest.approx(0.6))
    assert reports.metric_row(df, "m", "v")["model"] == "m"
    with pytest.raises(ValueError, match="no metrics"):
        reports.metric_row(df, "m", "x")


def test_fusion(spark):
    df = spark.createDataFrame([("a", [0.9, 0.1], [0.2, 0.8]), ("b", [0.3, 0.7], [0.6, 0.4])], "truth string, t array<double>, s array<double>")
    grid = selection.fusion_grid(df, "t", "s", ["a", "b"], "truth")
    assert {r["weight"]: r["top1"] for r in grid.collect()} == {0.25: 0.0, 0.5: 1.0, 0.75: 1.0}
    assert selection.best_weight(grid) == 0.5


def test_topic_library(spark):
    topics = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.9), (3, 1, 0.4)], "k int, topic_id int, topic_strength double")
    texts = spark.createDataFrame([(1, "2024-01-01", "one"), (2, "2025-02-01", "two"), (3, "2025-02-01", "three")], "k int, ldate string, text string").withColumn("ldate", F.to_date("ldate"))
    out = {r["topic_id"]: r for r in reports.topic_library(topics, texts, "k", "2025-01-01").collect()}
    assert (out[0]["development_share"], out[0]["forward_share"], out[0]["examples"]) == (1.0, 0.5, ["two", "one"])


def test_topics_are_fitted_before_the_cut(spark):
    """Forward cases change neither the vocabulary nor the topics of development cases, and get topics themselves."""
    rng = random.Random(3)
    words = {0: "gear slip shift clutch stall".split(), 1: "lamp dark bulb fuse flicker".split()}
    text = lambda i: " ".join(rng.choice(words[i % 2]) for _ in range(8))
    development = [(f"d{i:02d}", "2024-05-01", text(i)) for i in range(20)]
    forward = [(f"f{i:02d}", "2025-05-01", text(i) + " battery battery smoke") for i in range(30)]
    fit = lambda rows: pipelines.topic_model(spark.createDataFrame(rows, "odino string, ldate string, t string").withColumn("ldate", F.to_date("ldate")), "t", 2, 2, 3)
    (alone, factor, vocabulary), (every, factor_2, vocabulary_2) = fit(development), fit(development + forward)
    assert vocabulary == vocabulary_2 and "battery" not in vocabulary and any(" " in t for t in vocabulary)
    assert factor == pytest.approx(factor_2)
    alone, every = ({r["odino"]: r["topic_weights"] for r in df.collect()} for df in (alone, every))
    assert set(every) == {r[0] for r in development + forward}
    assert all(every[k] == pytest.approx(w) for k, w in alone.items())
    with pytest.raises(ValueError, match="no development cases"):
        fit(forward)


def test_narratives_are_lemmatised(spark):
    multi = spark.createDataFrame([("1", "MAKE", "MODEL", 2020, "2024-05-01", "era")], "odino string, maketxt string, modeltxt string, yeartxt int, ldate string, source_era string").withColumn("ldate", F.to_date("ldate"))
    sidecar = spark.createDataFrame([("1", "brakes squeal loudly whenever stopping downhill", False, False, 47, 6, "era")], "odino string, cdescr_model_text string, cdescr_missing_flag boolean, cdescr_placeholder_flag boolean, cdescr_char_len int, cdescr_word_count int, source_era string")
    row = pipelines.narrative_cache(multi, sidecar, lambda t: t.replace("brakes", "brake")).first()
    assert "brakes" in row["topic_text"].split() and "brake" in row["topic_lemma"].split() and "brakes" not in row["topic_lemma"].split()


def test_topics_query_runs_with_the_parameters_of_the_pipeline(spark, tmp_path, monkeypatch):
    seen = {}

    def keep(weights, key, topics, iterations=30, seed=7, fit=None):
        seen.update(topics=topics, iterations=iterations, terms={r["term"] for r in weights.select("term").distinct().collect()})
        return spark.createDataFrame([("1", [1.0])], "odino string, topic_weights array<double>"), None, None

    monkeypatch.setattr(pipelines.modeling, "nmf_topics", keep)
    # 5,200 terms of twenty documents each, which a vocabulary of 5,000 cannot hold
    rows = [(f"{i:03d}", "2024-05-01" if i < 40 else "2025-05-01", " ".join(f"w{n}" for n in range(2600)) if i < 20 else "later only") for i in range(80)]
    spark.createDataFrame(rows, "odino string, ldate string, cdescr string").withColumn("ldate", F.to_date("ldate")).coalesce(1).write.parquet(str(tmp_path / "odi_severity_cases.parquet"))
    assert relational.QUERIES["topics"](spark, str(tmp_path)).count() == 1
    assert (seen["topics"], seen["iterations"]) == (20, 20)
    assert len(seen["terms"]) > 5000 and "w1 w2" in seen["terms"]
