"""Model families and their fusion on small separable data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import evaluation, fusion, modeling
from caseloom.plans import pipelines

TOPICS = {"BRAKES": "pedal floor stop", "ENGINE": "stall oil smoke", "LIGHTS": "lamp dark bulb"}


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        own = rng.sample(sorted(TOPICS), 2)
        words = " ".join(rng.choice(TOPICS[own[0]].split()) for _ in range(6)) + " the car"
        rows.append((str(i), own[0], own, words if i % 40 else None, "odd" if own[0] == "BRAKES" else "even", float(len(own[0]) + rng.random()), "develop" if i < 120 else "select" if i < 180 else "holdout", i % 3 == 0))
    rows.append(("x", "NEW", ["NEW"], "pedal", "never", None, "holdout", False))
    rows.append(("y", None, [], "pedal", "odd", 1.0, "holdout", False))
    return spark.createDataFrame(rows, "odino string, label string, labels array<string>, text string, kind string, x double, split string, seen boolean")


def test_single_label(cases):
    final, metrics, chosen = fusion.single_label_run(cases, "label", "text", ["kind"], ["x"], seen="seen", least_df=2, rounds=3, characters=False)
    rows = {r["slice"]: r for r in metrics.collect()}
    assert set(rows) == {"all", "seen", "unseen"} and rows["all"]["n_rows"] == 61 == rows["seen"]["n_rows"] + rows["unseen"]["n_rows"]
    assert rows["all"]["top1_accuracy"] > 0.9 and rows["all"]["top3_accuracy"] >= rows["all"]["top1_accuracy"]
    assert chosen["classes"] == sorted(TOPICS) and chosen["weight"] in fusion.WEIGHTS and chosen["alpha"] in fusion.ALPHAS
    sums = final.select(F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("s"), F.size("p").alias("n")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 and r["n"] == 3 for r in sums)


def test_multi_label(cases):
    final, metrics, chosen = fusion.multi_label_run(cases, "labels", "text", ["kind"], ["x"], least_df=2, rounds=3, characters=False)
    assert final.count() == 61 and final.filter(F.size("guess") == 0).count() == 0
    assert metrics.first()["micro_f1"] > 0.6 and chosen["threshold"] in fusion.THRESHOLDS


def test_metrics_against_hand_count(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1], "a"), ([0.6, 0.3, 0.1], "b"), ([0.1, 0.2, 0.7], "c"), ([0.5, 0.5, 0.0], "d")], "p array<double>, t string")
    row = fusion.class_metrics(df, "p", ["a", "b", "c"], "t").first()
    assert (row["n_rows"], row["top1_accuracy"], row["top3_accuracy"], row["macro_f1"]) == (4, 0.5, 0.75, 0.375)


def test_text_matrix_and_prior(cases):
    train = fusion.with_terms(cases.filter("split = 'develop'"), "text")
    model = fusion.text_pipeline("words", "grams", 2).fit(train)
    out = model.transform(train).select(modeling.vector_to_array("text_features").alias("v"), "text").collect()
    assert all(abs(sum(x * x for x in r["v"]) - (2 if r["text"] else 0)) < 1e-6 for r in out)
    scored = fusion.prior_baseline(cases.filter("split = 'develop'"), cases.filter("split = 'holdout'"), "seen")
    assert scored.select("score").distinct().count() == 1 and scored.first()["score"] == pytest.approx(1 / 3)
    assert evaluation.average_precision(scored.withColumn("s", F.lit(1)), "score", "seen", ["s"]).count() == 1


def test_pipelines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        bad = rng.random() < 0.4
        rows.append((str(i), dt.date(2024 if i < 100 else 2025 if i < 150 else 2026, 3, 1 + i % 28), rng.choice(["fire burned", "crash hurt"] if bad else ["radio noise", "paint peels"]) + f" word{i % 4}", "TX" if bad else "OH", float(i % 7), bad, "BRAKES" if bad else "PAINT"))
    df = spark.createDataFrame(rows, "odino string, ldate date, cdescr string, state string, miles double, severity_primary_flag boolean, label string")
    _, metrics, chosen = pipelines.severity_fusion(df, "cdescr", ["state"], ["miles"], least_df=2, characters=False)
    got = {r["split"]: r["pr_auc"] for r in metrics.collect()}
    assert set(got) == {"select", "holdout"} and min(got.values()) > 0.95 and chosen["slope"] > 0
    _, metrics, _ = pipelines.component_single(df, "label", "cdescr", ["state"], ["miles"], least_df=2, rounds=2, characters=False)
    assert {r["slice"]: r["top1_accuracy"] for r in metrics.collect()}["seen"] > 0.9
