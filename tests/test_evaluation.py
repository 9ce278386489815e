"""Evaluation operators against direct computation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import evaluation as E


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(2)
    rows = [("m", f"{i:04d}", rng.random() < 0.3, round(rng.random(), 2)) for i in range(500)] + [("one", "x", True, 0.5), ("one", "y", True, 0.1)]
    return rows, spark.createDataFrame(rows, "model string, k string, truth boolean, score double").cache()


def test_average_precision_and_auc(scores):
    rows, df = scores
    part = [(s, t) for m, _, t, s in rows if m == "m"]
    values = sorted({s for s, _ in part}, reverse=True)
    total = sum(t for _, t in part)
    seen = hits = 0
    ap = 0.0
    for v in values:
        n, p = sum(s == v for s, _ in part), sum(s == v and t for s, t in part)
        seen, hits = seen + n, hits + p
        ap += p / total * hits / seen
    pairs = [(a > b) + 0.5 * (a == b) for a, x in part if x for b, y in part if not y]
    got = {r["model"]: r["pr_auc"] for r in E.average_precision(df, "score", "truth", ["model"]).collect()}
    auc = {r["model"]: r["roc_auc"] for r in E.roc_auc(df, "score", "truth", ["model"]).collect()}
    assert got["m"] == pytest.approx(ap) and got["one"] == 1.0
    assert auc["m"] == pytest.approx(sum(pairs) / len(pairs)) and auc["one"] is None


def test_budgets(scores, spark):
    rows, df = scores
    part = sorted([(-s, k, t) for m, k, t, s in rows if m == "m"])
    got = {r["budget_fraction"]: r for r in E.review_budgets(df, "score", "truth", "k", ["model"]).filter("model = 'm'").collect()}
    for f in E.BUDGETS:
        n = max(1, -(-int(len(part) * f * 1000) // 1000))
        assert (got[f]["flagged_rows"], got[f]["captured"]) == (n, sum(t for _, _, t in part[:n]))
    ties = spark.createDataFrame([("m", str(i), i % 2 == 0, 0.25) for i in range(4)], df.schema)
    row = E.review_budgets(ties, "score", "truth", "k", ["model"], (0.5,)).first()
    assert (row["flagged_rows"], row["captured"], row["precision_within_flagged_set"], row["recall_within_flagged_set"]) == (2, 1, 0.5, 0.5)


def test_power_calibration_and_grid(spark):
    df = spark.createDataFrame([("a", [0.6, 0.3, 0.1]), ("b", [0.2, 0.7, 0.1])], "truth string, p array<double>")
    sharp = [r[0] for r in df.select(E.power_calibration(F.col("p"), 2.0)).collect()]
    assert all(sum(p) == pytest.approx(1) for p in sharp) and sharp[0][0] > 0.6 and sharp[1].index(max(sharp[1])) == 1
    same = [r[0] for r in df.select(E.power_calibration(F.col("p"), 1.0)).collect()]
    assert same[0] == pytest.approx([0.6, 0.3, 0.1])
    grid = E.calibration_grid(df, "p", ["a", "b", "c"], "truth", [1.0, 2.0, 4.0])
    assert grid.count() == 3 and E.best_alpha(grid) > 1


def test_winner_rule():
    row = lambda b, r: {"brier_score": b, "recall_top_5pct": r}
    assert E.pick_calibration(row(0.03, 0.75), row(0.02, 0.749), row(0.0195, 0.749)) == "sigmoid"
    assert E.pick_calibration(row(0.03, 0.75), row(0.02, 0.7), row(0.029, 0.7)) == "raw"


def test_thresholds_and_vectors(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.2], ["a", "b", "c"])], "s array<double>, l array<string>")
    one = df.select(E.threshold_labels(F.col("s"), F.col("l"), 0.25).alias("x"), E.threshold_labels(F.col("s"), F.col("l"), 0.9, 2).alias("y"), E.top_k_labels(F.col("s"), F.col("l"), 2).alias("z"), E.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("u"), E.blend(F.col("s"), F.col("s"), 0.3).alias("w"), E.align_classes(F.col("s"), F.col("l"), ["c", "q"]).alias("v")).first()
    assert (one["x"], one["y"], one["z"], one["u"], one["v"]) == (["b"], ["b", "c"], ["b", "c"], [0.5, 0.5], [0.2, 0.0])
    assert one["w"] == pytest.approx([0.1, 0.3, 0.2])


def test_confusion_keeps_a_null_row(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("z", "a"), ("b", "z")], "t string, p string")
    got = {(r["true_group"], r["pred_group"]): r["row_share"] for r in E.confusion(df, "t", "p", ["a", "b"]).collect()}
    assert got == {("a", "a"): 0.5, ("a", "b"): 0.5, (None, "a"): 1.0}
