"""Evaluation of scores and predictions as relational operators: budgets, ranking metrics, calibration, confusion, thresholds.

A global ranking is never done in one task: rows are reduced to counts per distinct score first, and running sums over those
are taken in two levels (score buckets, then scores within a bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGETS = (0.01, 0.02, 0.05, 0.10)
SCORE_BUCKETS = 1024


def score_counts(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Per distinct score: rows and positives, with exclusive running sums from the highest score down (``above_n``, ``above_p``) and totals."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth)).alias("p"))
    counts = counts.withColumn("_b", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * SCORE_BUCKETS))
    buckets = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    whole = Window.partitionBy(*by)
    down = whole.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("_an"), F.coalesce(F.sum("_p").over(down), F.lit(0)).alias("_ap"),
        F.sum("_n").over(whole).alias("total_n"), F.sum("_p").over(whole).alias("total_p"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumns({"_in": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_ip": F.coalesce(F.sum("p").over(inside), F.lit(0))})
    on = reduce(lambda a, b: a & b, [ranked[c].eqNullSafe(buckets[f"_k_{c}"]) for c in by] + [ranked["_b"].eqNullSafe(buckets["_kb"])])
    joined = ranked.join(buckets, on)
    return joined.select(*by, "score", "n", "p", (F.col("_in") + F.col("_an")).alias("above_n"), (F.col("_ip") + F.col("_ap")).alias("above_p"), "total_n", "total_p", "_b")


def average_precision(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Sum over distinct scores of the gain in recall times the precision there; one class only: the mean of the truth."""
    s = score_counts(df, score, truth, by)
    term = (F.col("p") / F.col("total_p")) * ((F.col("above_p") + F.col("p")) / (F.col("above_n") + F.col("n")))
    ap = F.when((F.first("total_p") == 0) | (F.first("total_p") == F.first("total_n")), F.first("total_p") / F.first("total_n")).otherwise(F.sum(term))
    return s.groupBy(*by).agg(F.round(ap, 9).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Mann-Whitney with ties at half; null with one class only."""
    s = score_counts(df, score, truth, by)
    below = (F.col("total_n") - F.col("total_p")) - (F.col("above_n") - F.col("above_p")) - (F.col("n") - F.col("p"))
    wins = F.col("p") * (below + 0.5 * (F.col("n") - F.col("p")))
    pairs = F.first("total_p") * (F.first("total_n") - F.first("total_p"))
    return s.groupBy(*by).agg(F.round(F.when(pairs > 0, F.sum(wins) / pairs), 9).alias("roc_auc"))


def review_budgets(df: DataFrame, score: str, truth: str, key: str, by: list[str], fractions: tuple[float, ...] = BUDGETS) -> DataFrame:
    """Per fraction: rows flagged (at least one), positives captured, precision, recall, lift and score cut; ties by key.

    Scores above the cut are flagged from counts alone; only rows that tie at the cut score are ordered by key.
    """
    s = score_counts(df, score, truth, by)
    wide = s.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn("flagged_rows", F.greatest(F.ceil(F.round(F.col("total_n") * F.col("fraction"), 9)), F.lit(1)))
    cut = wide.filter((F.col("above_n") < F.col("flagged_rows")) & (F.col("above_n") + F.col("n") >= F.col("flagged_rows")))
    cut = cut.withColumn("_need", F.col("flagged_rows") - F.col("above_n"))
    tied = df.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(score).alias("_ks"), F.col(truth).alias("_t"), F.col(key).alias("_key"))
    on = reduce(lambda a, b: a & b, [cut[c].eqNullSafe(tied[f"_k_{c}"]) for c in by] + [cut["score"] == tied["_ks"]])
    at_cut = cut.join(tied, on).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "fraction").orderBy("_key")))
    got = at_cut.groupBy(*by, "fraction", "score", "flagged_rows", "above_p", "total_n", "total_p").agg(F.count_if((F.col("_r") <= F.col("_need")) & F.col("_t")).alias("_got"))
    captured = F.col("above_p") + F.col("_got")
    base = F.col("total_p") / F.col("total_n")
    return got.select(
        *by, F.col("fraction").alias("budget_fraction"), "flagged_rows", F.round(F.col("flagged_rows") / F.col("total_n"), 6).alias("flagged_share"), captured.alias("captured"),
        F.round(captured / F.nullif(F.col("total_p"), F.lit(0)), 6).alias("recall_within_flagged_set"), F.round(captured / F.col("flagged_rows"), 6).alias("precision_within_flagged_set"),
        F.round(captured / F.col("flagged_rows") / F.nullif(base, F.lit(0.0)), 6).alias("lift_vs_base_rate"), F.col("score").alias("score_cutoff"),
    )


def score_summary(df: DataFrame, score: str, truth: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at a threshold, and the Brier score."""
    hit = F.col(score) >= threshold
    tp, fp, fn = F.count_if(hit & F.col(truth)), F.count_if(hit & ~F.col(truth)), F.count_if(~hit & F.col(truth))
    brier = F.avg(F.pow(F.col(score) - F.col(truth).cast("int"), F.lit(2.0)))
    raw = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(brier, 9).alias("brier_score"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return raw.select(*by, "n_rows", F.round(safe(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"), "brier_score")


def reliability(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Quantile bins (right-closed, lowest included, equal edges merged): rows, mean score, observed rate, gap."""
    edges = df.agg(F.array_sort(F.array_distinct(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(bins + 1)])))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(score))) + 1)  # one-row side
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(score), 6).alias("avg_score"), F.round(F.avg(F.col(truth).cast("int")), 6).alias("observed_rate"), F.round(F.avg(F.col(truth).cast("int")) - F.avg(score), 6).alias("score_gap"))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence (right-closed, 0 in the first; empty bins kept) and the expected calibration error."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    binned = df.groupBy((F.size(F.filter(edges, lambda e: e < F.col(confidence))) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("int")).alias("acc"), F.avg(confidence).alias("conf"))
    total = Window.partitionBy()  # at most ``bins`` rows
    dims = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    full = dims.join(binned, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(total)
    ece = F.sum(share * F.abs(F.coalesce(F.col("acc") - F.col("conf"), F.lit(0.0)))).over(total)
    return full.select("bin", F.col("n").alias("n_rows"), F.round(share, 6).alias("share"), F.round("acc", 6).alias("accuracy"), F.round("conf", 6).alias("avg_confidence"), F.round(F.col("acc") - F.col("conf"), 6).alias("gap"), F.round(ece, 9).alias("ece"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")))).alias("s")).select("s.*")
    sums = sides.filter("c IS NOT NULL").groupBy(F.col("c").alias("class_name")).agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    safe = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return sums.select("class_name", "support", F.round(safe("hits", "predicted"), 6).alias("precision"), F.round(safe("hits", "support"), 6).alias("recall"), F.round(2 * F.col("hits") / (F.col("support") + F.col("predicted")), 6).alias("f1"))


def confusion(df: DataFrame, truth: str, predicted: str, focus: list[str]) -> DataFrame:
    """Counts and row shares of (truth, prediction) for predictions in focus; truths outside it form one null row."""
    kept = df.filter(F.col(predicted).isin(focus)).withColumn("true_group", F.when(F.col(truth).isin(focus), F.col(truth)))
    counts = kept.groupBy("true_group", F.col(predicted).alias("pred_group")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true_group")), 6))


# --- multi-label ---


def parse_labels(packed: Column) -> Column:
    """Labels of a pipe-joined text, blanks dropped."""
    return F.filter(F.split(F.coalesce(packed, F.lit("")), "[|]"), lambda x: x != "")


def threshold_labels(scores: Column, labels: Column, threshold: float, least: int = 0) -> Column:
    """Labels at or above the threshold; with fewer than ``least``, the highest-scoring ones instead (ties by position)."""
    zipped = F.arrays_zip(scores.alias("s"), labels.alias("l"))
    above = F.transform(F.filter(zipped, lambda z: z["s"] >= threshold), lambda z: z["l"])
    ranked = F.array_sort(F.transform(zipped, lambda z, i: F.struct((-z["s"]).alias("a"), i.alias("b"), z["l"].alias("l"))))
    return F.when(F.size(above) >= least, above).otherwise(F.transform(F.slice(ranked, 1, max(1, least)), lambda z: z["l"])) if least else above


def multilabel_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Micro and macro F1, exact-match rate and mean label counts; ``truth`` and ``predicted`` are label arrays."""
    hit = F.size(F.array_intersect(truth, predicted))
    micro = df.agg(F.sum(hit).alias("tp"), F.sum(F.size(truth)).alias("t"), F.sum(F.size(predicted)).alias("p"), F.avg(F.array_sort(truth).eqNullSafe(F.array_sort(predicted)).cast("int")).alias("exact"))
    sides = df.select(F.explode(F.concat(F.transform(truth, lambda x: F.struct(x.alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.array_contains(predicted, x).cast("int").alias("h"))), F.transform(predicted, lambda x: F.struct(x.alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h"))))).alias("s")).select("s.*")
    macro = sides.groupBy("c").agg((2 * F.sum("h") / (F.sum("t") + F.sum("p"))).alias("f1")).agg(F.avg("f1").alias("macro"), F.count(F.lit(1)).alias("labels"))
    return micro.crossJoin(macro).select(F.round(2 * F.col("tp") / (F.col("t") + F.col("p")), 6).alias("micro_f1"), F.round("macro", 6).alias("macro_f1"), F.round("exact", 6).alias("exact_match"), F.col("labels").alias("label_coverage"))  # one-row sides


def top_k_labels(scores: Column, labels: Column, k: int) -> Column:
    ranked = F.array_sort(F.transform(F.arrays_zip(scores.alias("s"), labels.alias("l")), lambda z, i: F.struct((-z["s"]).alias("a"), i.alias("b"), z["l"].alias("l"))))
    return F.transform(F.slice(ranked, 1, k), lambda z: z["l"])


# --- probability vectors ---


def softmax(scores: Column) -> Column:
    """Stable softmax; all-equal scores give the uniform distribution."""
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))


def power_calibration(probabilities: Column, alpha: float) -> Column:
    """p to the power alpha, renormalised."""
    powered = F.transform(probabilities, lambda p: F.pow(F.greatest(p, F.lit(1e-15)), F.lit(alpha)))
    return F.transform(powered, lambda p: p / F.aggregate(powered, F.lit(0.0), lambda a, b: a + b))


def normalize_rows(weights: Column) -> Column:
    """Weights divided by their sum; a zero row stays zero."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weights, lambda w: F.when(total > 0, w / total).otherwise(0.0))


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))


def align_classes(probabilities: Column, source: Column, target: list[str]) -> Column:
    """Probabilities in the order of the target classes; absent classes get 0."""
    by = F.map_from_arrays(source, probabilities)
    return F.transform(F.array(*[F.lit(t) for t in target]), lambda c: F.coalesce(F.element_at(by, c), F.lit(0.0)))


def calibration_grid(df: DataFrame, probabilities: str, classes: list[str], truth: str, alphas: list[float]) -> DataFrame:
    """Per alpha: ECE over ten bins, multiclass Brier, log loss, top-1 accuracy; one pass over the rows."""
    rows = df.select(F.col(truth).alias("truth"), F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), power_calibration(F.col(probabilities), a).alias("p")) for a in alphas])).alias("x")).select("truth", "x.*")
    names = F.array(*[F.lit(c) for c in classes])
    position = F.array_position(names, F.col("truth")).cast("int")
    conf = F.array_max("p")
    pred = F.array_position("p", conf).cast("int")
    own = F.when(position > 0, F.element_at("p", F.greatest(position, F.lit(1)))).otherwise(0.0)
    brier = F.aggregate("p", F.lit(0.0), lambda a, b: a + b * b) - 2 * own + 1
    edges = F.array(*[F.lit(i / 10) for i in range(1, 10)])
    scored = rows.select("alpha", conf.alias("conf"), (pred == position).cast("int").alias("hit"), brier.alias("brier"), (-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss")).withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("conf"))))
    bins = scored.groupBy("alpha", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.sum("conf").alias("c"), F.sum("brier").alias("b"), F.sum("loss").alias("l"))
    return bins.groupBy("alpha").agg(F.round(F.sum(F.abs(F.col("h") - F.col("c"))) / F.sum("n"), 9).alias("ece"), F.round(F.sum("b") / F.sum("n"), 9).alias("multiclass_brier"), F.round(F.sum("l") / F.sum("n"), 9).alias("log_loss"), F.round(F.sum("h") / F.sum("n"), 6).alias("top1_accuracy"))


def best_alpha(grid: DataFrame) -> float:
    """Least (ECE, Brier, log loss, alpha)."""
    return grid.orderBy("ece", "multiclass_brier", "log_loss", "alpha").first()["alpha"]


def pick_calibration(raw: dict, sigmoid_row: dict, isotonic: dict, recall_loss: float = 0.002, tie: float = 0.002) -> str:
    """Which calibration to use: better Brier than raw without losing recall; near ties go to the sigmoid."""
    fit = [(n, r) for n, r in (("sigmoid", sigmoid_row), ("isotonic", isotonic)) if r["brier_score"] < raw["brier_score"] and r["recall_top_5pct"] >= raw["recall_top_5pct"] - recall_loss]
    if not fit:
        return "raw"
    if len(fit) == 2 and abs(fit[0][1]["brier_score"] - fit[1][1]["brier_score"]) <= tie:
        return "sigmoid"
    return min(fit, key=lambda x: x[1]["brier_score"])[0]
