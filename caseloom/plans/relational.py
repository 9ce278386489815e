"""Queries over the relational core: cleaning, cases, text picks, history, splits, quality, watchlist, evaluation."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import columns as C
from caseloom.functions import text as X
from caseloom.operators import cases as K
from caseloom.operators import cleaning, evaluation, features, history, modeling, reports, selection, watchlist
from caseloom.plans import pipelines
from caseloom.plans.relational_sql import SQL  # noqa: F401
from caseloom.quality import report
from caseloom.session import load_table, spread

AUDITED = ["source_era", "flag_year_out_of_range", "flag_speed_999", "flag_state_bad", "flag_vin_len_bad", "flag_date_order_bad", "flag_fail_pre_model", "miles_zero_flag", "faildate_trusted_flag", "severity_primary_flag", "severity_broad_flag"]
PAIRS = [("train", "valid_2025", "2025-01-01", "2026-01-01"), ("train_core", "screen_2024", "2024-01-01", "2025-01-01"), ("dev_2020_2024", "select_2025", "2025-01-01", "2027-01-01")]


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_complaints(spread(load_table(spark, sf, "complaints")))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.component_rows(_clean(spark, sf), sizes=False).filter("component_keep_flag")


def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clean(spark, sf)
    return rows.select("cmplid", "odino", "source_file", "yeartxt", "ldate", "faildate", "miles", "veh_speed", "injured", "deaths", "state", "prod_type", "lag_days_safe", *AUDITED)


def clean_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clean(spark, sf)
    return rows.groupBy("source_era").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("odino").alias("cases"), *[F.count_if(F.col(c)).alias(c) for c in AUDITED[1:]])


def cleaning_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return K.cleaning_summary(_clean(spark, sf))


def component_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.component_rows(_clean(spark, sf))
    return rows.groupBy("component_group", "component_drop_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("odino").alias("cases"), F.max("component_group_rows").alias("component_group_rows"))


def multi_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = K.collapse_cases(_kept(spark, sf), "multi")
    return cases.select("odino", "component_row_count", "component_groups", "component_group_count", "mfr_name", "maketxt", "yeartxt", "state", "ldate", "miles", "veh_speed", "injured", "crash", "fire", "police_rpt_yn", "lag_days_safe", "severity_primary_flag", "severity_broad_flag")


def single_cases(spark: SparkSession, sf: str) -> DataFrame:
    return K.case_tables(cleaning.component_rows(_clean(spark, sf)))["single"].select("odino", "component_group", "fit_rows", "benchmark_keep_flag", "component_row_count")


def severity_rows(spark: SparkSession, sf: str) -> DataFrame:
    return K.severity_cases(_clean(spark, sf)).select("odino", "row_count", "component_count", "miles", "veh_speed", "crash", "fire", "severity_primary_flag", "severity_broad_flag")


def best_texts(spark: SparkSession, sf: str) -> DataFrame:
    return K.best_text(_clean(spark, sf)).select("odino", F.md5("cdescr_model_text").alias("text_md5"), "cdescr_missing_flag", "cdescr_placeholder_flag", "cdescr_char_len", "ldate")


def text_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return K.text_conflicts(_clean(spark, sf))


def text_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return K.text_overlap(K.best_text(_clean(spark, sf)), PAIRS)


def era_drift(spark: SparkSession, sf: str) -> DataFrame:
    return K.era_drift(_clean(spark, sf))


def conflict_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.conflict_summary(_clean(spark, sf), ["mfr_name", "maketxt", "modeltxt", "state", "miles", "veh_speed", "ldate"])


def scope_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.scope_summary(K.collapse_cases(_kept(spark, sf), "multi"))


def group_presence(spark: SparkSession, sf: str) -> DataFrame:
    return K.group_presence(_kept(spark, sf))


def prior_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_table(spark, sf, "odi_severity_cases").select("odino", "ldate", "mfr_name", "maketxt", "modeltxt", "yeartxt", "severity_primary_flag")
    out = history.prior_history(rows)
    return out.select("odino", *[c for n in history.KEY_SETS for c in (f"prior_count_{n}", f"prior_share_{n}")])


def age_and_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.requested_features(load_table(spark, sf, "odi_severity_cases").select("odino", "ldate", "state", "yeartxt"), ["vehicle_age", "vehicle_age_bucket", "complaint_quarter", "state_region"])
    return rows.groupBy("state_region", "vehicle_age_bucket", "complaint_quarter").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("vehicle_age").alias("sum_age"))


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return features.split_summary(load_table(spark, sf, "odi_severity_cases"), "feature_wave1", "severity_primary_flag")


def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    return report.quality_report(load_table(spark, sf, "complaints"), dates=["ldate", "faildate", "datea"], numbers={"miles": 7, "veh_speed": 3, "injured": 2}, lengths={"city": 12, "vin": 11}, codes={"crash": ["Y", "N"], "prod_type": ["V", "T", "E", "C"]}, keys=["cmplid"])


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.duplicate_rows(load_table(spark, sf, "complaints"))


def column_audit(spark: SparkSession, sf: str) -> DataFrame:
    return report.column_audit(load_table(spark, sf, "complaints"))


def outlier_profile(spark: SparkSession, sf: str) -> DataFrame:
    return report.outlier_profile(load_table(spark, sf, "odi_severity_cases"), ["miles", "veh_speed", "lag_days_safe", "row_count"])


def null_rates(spark: SparkSession, sf: str) -> DataFrame:
    return report.null_rates_by(load_table(spark, sf, "complaints"), "prod_type", ["miles", "state", "crash", "vin"])


def lag_bands(spark: SparkSession, sf: str) -> DataFrame:
    lag = F.col("lag_days_safe")
    band = F.when(lag.isNull(), "none").when(lag == 0, "same day").when(lag <= 7, "week").when(lag <= 30, "month").when(lag <= 90, "quarter").when(lag <= 365, "year").when(lag <= 1825, "five years").otherwise("longer")
    rows = load_table(spark, sf, "odi_severity_cases").withColumn("band", band)
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"), F.percentile("lag_days_safe", 0.95).alias("p95"))


def month_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clean(spark, sf).filter("ldate IS NOT NULL").withColumn("month", F.trunc("ldate", "MM"))
    return rows.groupBy("month").pivot("prod_type", ["C", "E", "T", "V"]).agg(F.count(F.lit(1))).fillna(0)


def yearly_rates(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "odi_severity_cases").groupBy(F.year("ldate").alias("yr")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col("severity_primary_flag").cast("int")), 6).alias("primary_rate"), F.round(F.avg(F.col("miles_missing_flag").cast("int")), 6).alias("miles_missing_rate"))


# --- watchlist ---


def _topic_rows(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    """Component rows with a stand-in topic: the number and kind follow from the component group.

    Coarse rows leave model and year null, so that cohorts are makes and null keys are exercised. The SQL of emerging_watchlist,
    risk_monitor, recurring_signals and signal_flow asks for these; their ``_full`` queries run over the whole cohort.
    """
    cases = load_table(spark, sf, "odi_component_multilabel_cases").filter("ldate IS NOT NULL")
    if coarse:
        cases = cases.withColumns({"modeltxt": F.lit(None).cast("string"), "yeartxt": F.lit(None).cast("int")})
    rows = watchlist.explode_groups(cases)
    topic = F.ascii("component_group") % 20
    return rows.select(
        "odino", "mfr_name", "maketxt", "modeltxt", "yeartxt", "state", F.trunc("ldate", "MM").alias("month"), "component_group", topic.alias("topic_id"), F.concat(F.lit("topic "), topic.cast("string")).alias("topic_label"),
        F.when(topic == 5, "recall_process").otherwise("defect").alias("topic_category"), F.when(topic == 5, "process").when(topic.isin(0, 14), "caution").otherwise("defect_watchlist").alias("watchlist_group"),
        (F.length("component_group") / 50).alias("topic_strength"), "severity_broad_flag", F.col("severity_primary_flag").alias("critical_event_near_operation_flag"),
    )


def _series(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    return watchlist.monthly_series(_topic_rows(spark, sf, coarse))


def cohort_growth(spark: SparkSession, sf: str) -> DataFrame:
    s = _series(spark, sf, coarse=False)
    return s.select("month", *watchlist.COHORT, "complaints", "unique_states", F.round("rolling_6mo_avg", 6).alias("rolling_6mo_avg"), F.round("growth_vs_6mo_avg", 6).alias("growth_vs_6mo_avg"), F.round("growth_delta_6mo", 6).alias("growth_delta_6mo"), "new_or_reemerging_signal", "emerging_signal_flag", F.round("watchlist_score", 6).alias("watchlist_score"))


def emerging_watchlist(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    watch, _ = watchlist.watchlist_views(_series(spark, sf, coarse))
    return watch.select("month", "mfr_name", "maketxt", "modeltxt", "yeartxt", "component_group", "topic_id", "complaints", F.round("watchlist_score", 6).alias("watchlist_score"), "signal_tier", "watchlist_reason")


def risk_monitor(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    _, risk = watchlist.watchlist_views(_series(spark, sf, coarse))
    return risk.select("month", "maketxt", "modeltxt", "yeartxt", "component_group", "topic_id", "complaints", F.round("watchlist_score", 6).alias("watchlist_score"), "monitor_reason")


def watchlist_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _topic_rows(spark, sf, coarse=False)
    watch, _ = watchlist.watchlist_views(watchlist.monthly_series(rows))
    out = watchlist.watchlist_summary(rows, watch)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def recurring_signals(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    watch, _ = watchlist.watchlist_views(_series(spark, sf, coarse))
    return watchlist.recurring_signals(watch)


def global_topic_month(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["topic_id"]
    s = watchlist.add_growth(watchlist.complete_months(watchlist.cohort_months(_topic_rows(spark, sf), keys), keys), keys)
    return s.select("topic_id", "month", "complaints", F.round("growth_vs_6mo_avg", 6).alias("growth_vs_6mo_avg"))


def signal_flow(spark: SparkSession, sf: str, coarse: bool = True) -> DataFrame:
    watch, _ = watchlist.watchlist_views(_series(spark, sf, coarse))
    return watch.groupBy("month").pivot("signal_tier", list(watchlist.TIERS)).agg(F.count(F.lit(1))).fillna(0).select("month", *[F.col(t).alias(t.lower().replace(" ", "_").replace("-", "_")) for t in watchlist.TIERS])


def emerging_watchlist_full(spark: SparkSession, sf: str) -> DataFrame:
    return emerging_watchlist(spark, sf, coarse=False)


def risk_monitor_full(spark: SparkSession, sf: str) -> DataFrame:
    return risk_monitor(spark, sf, coarse=False)


def recurring_signals_full(spark: SparkSession, sf: str) -> DataFrame:
    return recurring_signals(spark, sf, coarse=False)


def signal_flow_full(spark: SparkSession, sf: str) -> DataFrame:
    return signal_flow(spark, sf, coarse=False)


def clue_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the latest flagged signals; narratives come from the severity cases."""
    rows = _topic_rows(spark, sf, coarse=False)
    watch, _ = watchlist.watchlist_views(watchlist.monthly_series(rows))
    texts = rows.withColumn("modeltxt", F.coalesce("modeltxt", F.lit("any"))).join(load_table(spark, sf, "odi_severity_cases").select("odino", F.col("cdescr").alias("text")), "odino")
    return watchlist.clue_terms(texts, watch.withColumn("modeltxt", F.coalesce("modeltxt", F.lit("any"))), ["the", "and", "was", "it"])


# --- evaluation: a deterministic stand-in score ---


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_table(spark, sf, "odi_severity_cases").filter("severity_primary_flag IS NOT NULL AND odino IS NOT NULL")
    raw = (F.coalesce(F.col("veh_speed"), F.lit(20)) % 100) / 125 + F.when(F.col("severity_primary_flag"), 0.125).otherwise(0.0)
    return rows.select("odino", F.year("ldate").alias("yr"), F.col("severity_primary_flag").alias("truth"), raw.alias("score")).filter("yr IS NOT NULL")


def review_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.review_budgets(_scores(spark, sf), "score", "truth", "odino", ["yr"])


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.average_precision(_scores(spark, sf), "score", "truth", ["yr"])


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_auc(_scores(spark, sf), "score", "truth", ["yr"])


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_summary(_scores(spark, sf), "score", "truth", ["yr"])


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.reliability(_scores(spark, sf), "score", "truth")


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration_bins(_scores(spark, sf), "score", "truth")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """True group against a stand-in prediction: the first of the case's groups against the last."""
    rows = load_table(spark, sf, "odi_component_multilabel_cases").withColumn("labels", evaluation.parse_labels(F.col("component_groups"))).filter(F.size("labels") > 0)
    return rows.select("odino", "labels", F.col("labels")[0].alias("truth"), F.element_at("labels", -1).alias("predicted"))


FOCUS = ["AIR BAGS", "ELECTRICAL SYSTEM", "ENGINE / COOLING", "STEERING", "SUSPENSION"]


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.class_report(_labels(spark, sf), "truth", "predicted")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(_labels(spark, sf), "truth", "predicted", FOCUS)


def multilabel_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf).select(F.array_distinct("labels").alias("truth"), F.array_distinct(F.array("truth", "predicted")).alias("guess"))
    return evaluation.multilabel_metrics(rows, "truth", "guess")


def label_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf)
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    return rows.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("prevalence"))


# --- text ---


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(load_table(spark, sf, "odi_severity_cases")).select("odino", "cdescr", X.max_mph(F.col("cdescr")).alias("max_mph"), F.coalesce(F.col("cdescr").rlike(X.HIGHWAY), F.lit(False)).alias("highway_flag"), C.is_placeholder(F.col("cdescr")).alias("placeholder_flag"))
    return rows.drop("cdescr")


def context_flags(spark: SparkSession, sf: str) -> DataFrame:
    return X.context_flags(spread(load_table(spark, sf, "odi_severity_cases")).select("odino", "cdescr"), "cdescr").drop("cdescr")


def topic_text(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = spread(load_table(spark, sf, "odi_severity_cases")).select("odino", X.remove_identifiers(X.clean_for_topics(F.col("cdescr")), F.col("maketxt"), F.col("modeltxt"), F.col("yeartxt")).alias("topic_text"))
    return cleaned.withColumn("word_count", C.word_count(F.col("topic_text")))


def severity_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load_table(spark, sf, "odi_severity_cases")).select("odino", X.severity_text(F.col("cdescr")).alias("model_text"))


def personal_strip(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load_table(spark, sf, "complaints")).select("cmplid", F.md5(X.remove_personal(F.col("cdescr"))).alias("text_md5")).distinct()


def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(load_table(spark, sf, "odi_severity_cases")).filter("cdescr IS NOT NULL").select("odino", F.col("cdescr").alias("text"))
    totals = modeling.tfidf_totals(docs, "odino", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)), least_df=5, most_share=0.75)
    return totals.select("term", "docs", F.round("total", 5).alias("total_weight"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """The topics of the early-warning pipeline with its parameters, over uncleaned narratives."""
    docs = spread(load_table(spark, sf, "odi_severity_cases")).filter("cdescr IS NOT NULL").select("odino", "ldate", F.col("cdescr").alias("text"))
    if not modeling.one_row_per_key(docs, "odino"):
        docs = docs.dropDuplicates(["odino"])
    doc_topics, _, _ = pipelines.topic_model(docs, "text")
    return modeling.topic_rows(doc_topics, "odino").groupBy("topic_id").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("topic_strength"), 6).alias("avg_strength"), F.count_if("strong_topic_flag").alias("strong"))


def severity_model(spark: SparkSession, sf: str) -> DataFrame:
    """Structured severity model: fitted before 2025, scored after; its review metrics."""
    cases = load_table(spark, sf, "odi_severity_cases").filter("severity_primary_flag IS NOT NULL AND ldate IS NOT NULL").withColumn("split", features.split_column(F.col("ldate"), "benchmark_v1"))
    frame = features.model_frame(cases, ["state", "cmpl_type", "fuel_type", "miles", "veh_speed", "lag_days_safe", "component_count"], "severity_primary_flag")
    frame = frame.join(cases.select("odino", "split"), "odino").withColumn("label", F.col("target").cast("double"))
    train = frame.filter("split = 'train'")
    model = modeling.structured_pipeline(["state", "cmpl_type", "fuel_type"], ["miles", "veh_speed", "lag_days_safe", "component_count"], with_mean=False).fit(train)
    fitted = modeling.fit_logistic(model.transform(train))
    scored = fitted.transform(model.transform(frame.filter("split <> 'train'"))).select("odino", "split", F.col("target").alias("truth"), F.round(modeling.vector_to_array("probability")[1], 9).alias("score"))
    ap, auc = (f(scored, "score", "truth", ["split"]) for f in (evaluation.average_precision, evaluation.roc_auc))
    return evaluation.score_summary(scored, "score", "truth", ["split"]).join(ap, "split").join(auc, "split")


# --- reports and selection ---


def topic_mix(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["topic_id", "maketxt"]
    return reports.topic_mix(watchlist.cohort_months(_topic_rows(spark, sf), keys))


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["maketxt", "component_group"]
    months = watchlist.cohort_months(_topic_rows(spark, sf), keys).withColumn("score", F.col("complaints") + F.col("unique_states"))
    return reports.leaderboard(months, "score", 12, tuple(keys)).select("month", *keys, "complaints", "score")


def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reports.label_shares(_labels(spark, sf), "truth")


def share_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_table(spark, sf, "odi_severity_cases").filter("state IS NOT NULL")
    cut = F.lit("2024-01-01").cast("date")
    return reports.share_shift(rows.filter(F.col("ldate") < cut), rows.filter(F.col("ldate") >= cut), "state")


def urgency_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.urgency_bands(_scores(spark, sf), "score", "truth", "odino", ["yr"])
    return rows.groupBy("yr", "band").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("truth").alias("severe"), F.round(F.max("percent_rank"), 6).alias("last_place"))


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Decoding a stand-in score: a label's share of its case's text."""
    rows = _labels(spark, sf).select(F.array_distinct("labels").alias("all"), "truth")
    scored = rows.select(F.array("truth").alias("truth"), F.col("all").alias("names"), F.transform("all", lambda x: F.length(x) / 40).alias("scores"))
    return selection.threshold_grid(scored, "scores", "names", "truth", [0.2, 0.3, 0.4])


def latest_case_per_make(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_table(spark, sf, "odi_severity_cases").filter("ldate IS NOT NULL").select("maketxt", "odino", "ldate")
    return reports.first_per_group(rows, ["maketxt"], [F.col("ldate").desc(), F.col("odino")]).withColumn("ldate", F.to_date("ldate"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Models seen before 2024 only, since then only, and in both."""
    rows = load_table(spark, sf, "odi_severity_cases").filter("modeltxt IS NOT NULL AND ldate IS NOT NULL")
    cut = F.lit("2024-01-01").cast("date")
    before, since = rows.filter(F.col("ldate") < cut).select("modeltxt"), rows.filter(F.col("ldate") >= cut).select("modeltxt")
    parts = (("before", before.subtract(since)), ("since", since.subtract(before)), ("both", before.intersect(since)))
    out = [df.select(F.lit(name).alias("part"), "modeltxt") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return rows.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.countDistinct("user_id").alias("users"))


def _dates_as_text(f):
    """Dates leave a query as ISO text, so that any client reads them alike."""

    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

    return run


QUERIES = {
    f.__name__: _dates_as_text(f)
    for f in (
        clean_rows, clean_summary, cleaning_metrics, component_groups, multi_cases, single_cases, severity_rows, best_texts, text_conflicts, text_overlap, era_drift, conflict_summary, scope_summary,
        group_presence, prior_history, age_and_region, split_summary, quality_checks, duplicate_rows, column_audit, outlier_profile, null_rates, lag_bands, month_mix, yearly_rates, cohort_growth,
        emerging_watchlist, risk_monitor, watchlist_summary, recurring_signals, global_topic_month, signal_flow, emerging_watchlist_full, risk_monitor_full, recurring_signals_full, signal_flow_full, clue_terms, review_budgets, average_precision, roc_auc, score_summary, reliability,
        calibration, class_report, confusion, multilabel_metrics, label_prevalence, text_features, context_flags, topic_text, severity_text, personal_strip, tfidf_terms, topics, severity_model,
        topic_mix, leaderboard, label_shares, share_shift, urgency_bands, threshold_grid, latest_case_per_make, set_operations, event_properties,
    )
}
