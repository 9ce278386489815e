"""Choosing thresholds and blend weights: a small grid against all rows, scored in one aggregation per grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.evaluation import blend, threshold_labels, top_k_labels


def threshold_grid(df: DataFrame, scores: str, labels: str, truth: str, thresholds: list[float], least: int = 0) -> DataFrame:
    """Micro and macro F1 of multi-label decoding per threshold."""
    guesses = F.array(*[F.struct(F.lit(t).alias("threshold"), threshold_labels(F.col(scores), F.col(labels), t, least).alias("guess")) for t in thresholds])
    rows = df.select(F.col(truth).alias("truth"), F.explode(guesses).alias("g")).select("truth", "g.*")
    cells = F.concat(F.transform("truth", lambda x: F.struct(x.alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.array_contains("guess", x).cast("int").alias("h"))), F.transform("guess", lambda x: F.struct(x.alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h"))))
    per = rows.select("threshold", F.explode(cells).alias("x")).select("threshold", "x.*").groupBy("threshold", "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return per.groupBy("threshold").agg(F.round(2 * F.sum("h") / (F.sum("t") + F.sum("p")), 6).alias("micro_f1"), F.round(F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))), 6).alias("macro_f1"))


def best_threshold(grid: DataFrame) -> float:
    """Highest macro F1, then micro F1, then the lower threshold."""
    return grid.orderBy(F.col("macro_f1").desc(), F.col("micro_f1").desc(), "threshold").first()["threshold"]


def fusion_grid(df: DataFrame, text: str, structured: str, classes: list[str], truth: str, weights: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Top-1, top-3 accuracy and macro F1 of blended probabilities per text weight."""
    names = F.array(*[F.lit(c) for c in classes])
    mixed = F.array(*[F.struct(F.lit(w).alias("weight"), blend(F.col(text), F.col(structured), w).alias("p")) for w in weights])
    rows = df.select(F.col(truth).alias("truth"), F.explode(mixed).alias("m")).select("truth", "m.*").withColumn("top", top_k_labels(F.col("p"), names, 3))
    rows = rows.select("weight", "truth", F.col("top")[0].alias("guess"), F.array_contains("top", F.col("truth")).cast("int").alias("in3"))
    accuracy = rows.groupBy("weight").agg(F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("top1"), F.round(F.avg("in3"), 6).alias("top3"))
    sides = rows.select("weight", F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("guess").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("truth") == F.col("guess")).cast("int").alias("h")))).alias("s")).select("weight", "s.*")
    f1 = sides.groupBy("weight", "c").agg((2 * F.sum("h") / (F.sum("t") + F.sum("p"))).alias("f1")).groupBy("weight").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return accuracy.join(f1, "weight")


def best_weight(grid: DataFrame) -> float:
    """Highest (macro F1, top-1, top-3), then the lower weight."""
    return grid.orderBy(F.col("macro_f1").desc(), F.col("top1").desc(), F.col("top3").desc(), "weight").first()["weight"]
