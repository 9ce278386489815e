"""End-to-end runs: preprocessing, early warning, severity benchmark. Each stage is written once and read again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.columns import word_count
from caseloom.operators import cases, cleaning, evaluation, features, fusion, modeling, watchlist
from caseloom.sources import sinks

LEAST_WORDS = 5
STOP = ("the", "and", "was", "it", "to", "of", "in", "is", "on", "that", "for", "with", "my", "at")


def preprocess(spark: SparkSession, complaints: DataFrame, out: str) -> dict[str, DataFrame]:
    """Raw rows to cleaned rows, case tables, text sidecar and diagnostics under ``out``."""
    write = lambda name, df: spark.read.parquet(sinks.write_frame(df, f"{out}/{name}.parquet"))
    clean = write("cleaned", cleaning.clean_complaints(complaints))
    components = write("component_rows", cleaning.component_rows(clean))
    tables = {name: write(f"cases_{name}", df) for name, df in cases.case_tables(components).items()}
    return {"cleaned": clean, "components": components, **tables, "severity": write("cases_severity", cases.severity_cases(clean)), "text": write("text_sidecar", cases.best_text(clean)), "drift": write("era_drift", cases.era_drift(clean))}


def narrative_cache(multi: DataFrame, sidecar: DataFrame, lemmatizer: Callable[[str], str] = str.lower) -> DataFrame:
    """Cases with a usable narrative, cleaned for topics and lemmatised, with context flags."""
    joined = cases.merge_text(multi, sidecar).filter(~F.col("cdescr_missing_flag") & ~F.col("cdescr_placeholder_flag"))
    usable = joined.filter(~F.coalesce(F.substring("cdescr_model_text", 1, 25).rlike(r"(?i)\battached\s+documents?\b"), F.lit(False)))
    flagged = X.context_flags(usable, "cdescr_model_text")
    cleaned = flagged.withColumn("topic_text", X.remove_identifiers(X.clean_for_topics(F.col("cdescr_model_text")), F.col("maketxt"), F.col("modeltxt"), F.col("yeartxt")))
    worded = cleaned.filter(word_count(F.col("topic_text")) >= LEAST_WORDS).withColumn("month", F.trunc("ldate", "MM"))
    return X.lemmatize(worded, "topic_text", "topic_lemma", lemmatizer)


def topic_model(docs: DataFrame, text: str, topics: int = 20, least_df: int = 20, iterations: int = 20) -> tuple[DataFrame, np.ndarray, list[str]]:
    """Topics of every document; terms, document frequencies and factor are fitted on the cases before the development cut.

    ``docs``: odino, ldate and the text, a row per case (an error if not). Without a development case there is nothing to fit on, which is an error.
    """
    fitted = features.split_column(F.col("ldate"), "topic") == "development"
    development = docs.filter(fitted)
    if development.isEmpty():
        raise ValueError("no development cases to fit topics on")
    weights = modeling.tfidf_matrix(docs, "odino", modeling.word_grams(F.col(text), list(STOP), two=False), least_df=least_df, most_share=0.75, vocabulary=50_000, fitted=fitted, pairs=True)
    return modeling.nmf_topics(weights, "odino", topics, iterations, fit=development)


def early_warning(spark: SparkSession, multi: DataFrame, sidecar: DataFrame, out: str, topics: int = 20, least_df: int = 20, iterations: int = 20, lemmatizer: Callable[[str], str] = str.lower) -> dict[str, DataFrame]:
    """Narratives to topics to cohort watchlists; topics are fitted before the development cut and applied to all cases."""
    write = lambda name, df: spark.read.parquet(sinks.write_frame(df, f"{out}/{name}.parquet"))
    cache = write("nlp_cache", narrative_cache(multi, sidecar, lemmatizer))
    doc_topics, factor, vocabulary = topic_model(cache.select("odino", "ldate", "topic_lemma"), "topic_lemma", topics, least_df, iterations)
    named = spark.createDataFrame([(i, ", ".join(t[:3])) for i, t in enumerate(modeling.top_terms(factor, vocabulary))], "topic_id int, topic_label string")
    strong = modeling.topic_rows(doc_topics, "odino").filter("strong_topic_flag").join(F.broadcast(named), "topic_id")
    rows = watchlist.explode_groups(cache.join(strong, "odino")).withColumns({"topic_category": F.lit("defect"), "watchlist_group": F.lit("defect_watchlist")})
    rows = write("component_topics", rows)
    watch, risk = watchlist.watchlist_views(watchlist.monthly_series(rows))
    watch = write("watchlist", watch)
    return {"cache": cache, "rows": rows, "watchlist": watch, "risk": write("risk_monitor", risk), "summary": write("watchlist_summary", watchlist.watchlist_summary(rows, watch)), "recurring": write("recurring_signals", watchlist.recurring_signals(watch)), "clues": write("clue_terms", watchlist.clue_terms(rows.withColumn("text", F.col("topic_text")), watch, list(STOP)))}


def severity_benchmark(severity: DataFrame, categories: list[str], numbers: list[str], key: str = "odino") -> tuple[DataFrame, DataFrame]:
    """(scores, metrics) of the structured severity model, fitted before 2025 and calibrated by Platt scaling on 2025."""
    rows = severity.filter("severity_primary_flag IS NOT NULL AND ldate IS NOT NULL").withColumn("split", features.split_column(F.col("ldate"), "benchmark_v1"))
    frame = features.model_frame(rows, [*categories, *numbers], "severity_primary_flag", key).join(rows.select(key, "split"), key).withColumn("label", F.col("target").cast("double"))
    pipeline = modeling.structured_pipeline(categories, numbers).fit(frame.filter("split = 'train'"))
    ready = pipeline.transform(frame)
    scored = modeling.fit_logistic(ready.filter("split = 'train'")).transform(ready).withColumn("raw", modeling.vector_to_array("rawPrediction")[1])
    slope, intercept = modeling.platt(scored.filter("split = 'valid_2025'").select("raw", "label"), "raw", "label")
    scores = scored.filter("split <> 'train'").select(key, "split", F.col("target").alias("truth"), F.round(evaluation.sigmoid(F.col("raw") * slope + intercept), 9).alias("score"))
    by = ["split"]
    metrics = evaluation.score_summary(scores, "score", "truth", by).join(evaluation.average_precision(scores, "score", "truth", by), by).join(evaluation.roc_auc(scores, "score", "truth", by), by)
    return scores, metrics


def _stages(rows: DataFrame) -> DataFrame:
    """Adds ``split``: develop before 2025, select in 2025, holdout since; rows without a date belong to none."""
    split = features.split_column(F.col("ldate"), "benchmark_v1")
    return rows.withColumn("split", F.when(split == "train", "develop").when(split == "valid_2025", "select").when(split == "holdout_2026", "holdout")).filter("split IS NOT NULL")


def component_single(single: DataFrame, label: str, text: str, categories: list[str], numbers: list[str], key: str = "odino", **options) -> tuple[DataFrame, DataFrame, dict]:
    """(holdout probabilities, metrics overall and for texts seen before or not, choices) of the fused one-component model."""
    rows = _stages(single)
    earlier = rows.filter("split <> 'holdout'").select(F.xxhash64(text).alias("_h"), F.lit(True).alias("_seen")).filter(F.col("_h").isNotNull()).distinct()
    marked = rows.withColumn("_h", F.xxhash64(text)).join(earlier, "_h", "left").withColumn("text_seen_flag", F.col("_seen").isNotNull() & F.col(text).isNotNull()).drop("_h", "_seen")
    return fusion.single_label_run(marked, label, text, categories, numbers, key, seen="text_seen_flag", **options)


def component_multi(multi: DataFrame, labels: str, text: str, categories: list[str], numbers: list[str], key: str = "odino", **options) -> tuple[DataFrame, DataFrame, dict]:
    """(holdout decodings, metrics, choices) of the fused many-component model; ``labels`` is an array column."""
    return fusion.multi_label_run(_stages(multi), labels, text, categories, numbers, key, **options)


def severity_fusion(severity: DataFrame, text: str, categories: list[str], numbers: list[str], key: str = "odino", target: str = "severity_primary_flag", least_df: int = 5, vocabulary: int = 30_000, characters: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(scores, metrics per split, choices): a text and a structured model blended by the weight of best average precision in
    2025, then calibrated there by a sigmoid of the log odds (which keeps the order, so recall within a budget stays)."""
    rows = _stages(severity.filter(F.col(target).isNotNull())).withColumn("model_text", X.severity_text(F.col(text)))
    rows = fusion.with_terms(rows, "model_text", characters=characters).withColumn("label", F.col(target).cast("double"))
    train = rows.filter("split = 'develop'")
    words, table = fusion.text_pipeline("words", "grams" if characters else None, least_df, vocabulary=vocabulary).fit(train), modeling.structured_pipeline(categories, numbers).fit(train)
    ready = modeling.materialize(table.transform(words.transform(rows)).select(key, "split", "label", "text_features", "features"), "severity-features")
    scored = ready.filter("split <> 'develop'")
    for name, column in (("p_text", "text_features"), ("p_table", "features")):
        scored = modeling.fit_logistic(ready.filter("split = 'develop'"), column).transform(scored).withColumn(name, modeling.vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    scored = modeling.materialize(scored.select(key, "split", "label", (F.col("label") == 1).alias("truth"), "p_text", "p_table"), "severity-scores")
    grid = scored.filter("split = 'select'").select("truth", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), (F.col("p_text") * w + F.col("p_table") * (1 - w)).alias("score")) for w in fusion.WEIGHTS])).alias("x")).select("truth", "x.*")
    weight = evaluation.average_precision(grid, "score", "truth", ["weight"]).orderBy(F.col("pr_auc").desc(), "weight").first()["weight"]
    raw = scored.withColumn("score", F.col("p_text") * weight + F.col("p_table") * (1 - weight))
    odds = raw.withColumn("odds", F.log(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9))))
    slope, intercept = modeling.platt(odds.filter("split = 'select'").select("odds", "label"), "odds", "label")
    final = odds.select(key, "split", "truth", F.round(evaluation.sigmoid(F.col("odds") * slope + intercept), 9).alias("score"))
    by = ["split"]
    metrics = evaluation.score_summary(final, "score", "truth", by).join(evaluation.average_precision(final, "score", "truth", by), by).join(evaluation.roc_auc(final, "score", "truth", by), by)
    return final, metrics, {"weight": weight, "slope": slope, "intercept": intercept}
