"""Early warning over cohorts: monthly series on a dense grid, growth against the prior months, scores, tiers and summaries.

The grid comes from ``explode(sequence(first, last, 1 month))`` per cohort (no cross join); growth is one window over the cohort's
months. Null cohort keys are keys like any other. All rankings have a full order, so ties do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.columns import format_year
from caseloom.operators.cases import sorted_distinct_text
from caseloom.session import materialize

COHORT = ["maketxt", "modeltxt", "yeartxt", "component_group", "topic_id", "topic_label", "topic_category", "watchlist_group"]
RATES = {"severity_broad_rate": "severity_broad_flag", "critical_event_near_operation_rate": "critical_event_near_operation_flag", "in_operation_rate": "in_operation_flag", "highway_rate": "highway_flag", "high_speed_rate": "high_speed_flag"}
TIERS = ("Monitor", "Early signal", "Moderate signal", "High-confidence signal")
GROUP_WEIGHTS = {"defect_watchlist": 1.0, "caution": 0.65, "process": 0.45}
OTHER_GROUP_WEIGHT = 0.6
WINDOW_MONTHS, LEAST_PRIOR = 6, 3
GROWTH_LEAST, COMPLAINTS_LEAST = 2.0, 3
RISK_SEVERITY, RISK_CRITICAL, RISK_SPEED, STRONG_MATCH = 0.35, 0.25, 0.35, 0.45


def explode_groups(cases: DataFrame, packed: str = "component_groups") -> DataFrame:
    """One row per component group of a pipe-joined text; blank places dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    return cases.withColumn("component_group", F.explode(parts))


def same_keys(a: DataFrame, b: DataFrame, keys: Iterable[str], prefix: str = "_k_") -> tuple[Column, DataFrame, list[str]]:
    """A null-safe equi-join condition, the right side with its keys renamed, and the names to drop afterwards."""
    names = list(keys)
    right = b.select([F.col(c).alias(prefix + c) if c in names else F.col(c) for c in b.columns])
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(right[prefix + c]) for c in names]), right, [prefix + c for c in names]


def cohort_months(rows: DataFrame, cohort: list[str], entity: str = "odino", rates: dict[str, str] | None = None, names: str | None = None) -> DataFrame:
    """Observed months: distinct entities and states, mean topic strength, and rates of the boolean columns there are.

    ``names``: a column whose distinct trimmed texts are gathered as ``_names``.
    """
    rates = {k: v for k, v in (RATES if rates is None else rates).items() if v in rows.columns}
    aggregates = [F.countDistinct(entity).alias("complaints"), F.countDistinct("state").alias("unique_states")]
    if "topic_strength" in rows.columns:
        aggregates.append(F.avg("topic_strength").alias("avg_topic_strength"))
    aggregates += [F.avg(F.col(c).cast("int")).alias(r) for r, c in rates.items()]
    if names:
        aggregates.append(F.collect_set(F.nullif(F.trim(names), F.lit(""))).alias("_names"))
    return rows.filter(F.col("month").isNotNull()).groupBy("month", *cohort).agg(*aggregates)


def complete_months(months: DataFrame, cohort: list[str], last_month: Column | None = None) -> DataFrame:
    """Every month of each cohort from its first observation to the last month of all, zero-filled.

    The last month is a scalar (one-row side), so no cohort x calendar product is built.
    """
    last = months.agg((last_month if last_month is not None else F.max("month")).alias("_last"))
    spans = months.groupBy(*cohort).agg(F.min("month").alias("_first")).crossJoin(F.broadcast(last))
    grid = spans.select(*cohort, F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias("month"))
    on, right, gone = same_keys(grid, months, ["month", *cohort])
    measures = [c for c in months.columns if c not in ("month", *cohort)]
    joined = grid.join(right, on, "left").drop(*gone)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in measures})


def add_growth(months: DataFrame, cohort: list[str], count: str = "complaints") -> DataFrame:
    """Mean of the six months before (three at least), growth and difference against it, and whether the signal is new."""
    before = Window.partitionBy(*cohort).orderBy("month").rowsBetween(-WINDOW_MONTHS, -1)
    enough = F.count(count).over(before) >= LEAST_PRIOR
    out = months.withColumns({"rolling_6mo_avg": F.when(enough, F.avg(count).over(before)), "prior_6mo_sum": F.when(enough, F.sum(count).over(before))})
    base = F.when(F.col("rolling_6mo_avg").isNotNull(), F.greatest("rolling_6mo_avg", F.lit(1.0)))
    return out.withColumns(
        {
            "growth_vs_6mo_avg": F.col(count) / base,
            "growth_delta_6mo": F.col(count) - F.coalesce("rolling_6mo_avg", F.lit(0.0)),
            "new_or_reemerging_signal": (F.coalesce("prior_6mo_sum", F.lit(0)) == 0) & (F.col(count) >= COMPLAINTS_LEAST),
        }
    )


def add_emerging(months: DataFrame, growth_least: float = GROWTH_LEAST) -> DataFrame:
    return months.withColumn("emerging_signal_flag", F.coalesce(F.col("growth_vs_6mo_avg") >= growth_least, F.lit(False)) | F.col("new_or_reemerging_signal"))


def add_score(months: DataFrame) -> DataFrame:
    """The watchlist score: volume x growth x novelty x severity x operation x confidence x kind of topic. Absent rates count 0."""
    col = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in months.columns else F.lit(0.0)
    growth = F.greatest(F.least(F.coalesce("growth_vs_6mo_avg", F.lit(1.0)), F.lit(4.0)), F.lit(0.5))
    weight = F.when(F.lit(False), 0.0)
    for group, w in GROUP_WEIGHTS.items():
        weight = weight.when(F.col("watchlist_group") == group, w)
    weight = weight.otherwise(OTHER_GROUP_WEIGHT)
    score = (
        F.log1p("complaints") * growth * F.when(F.col("new_or_reemerging_signal"), 1.35).otherwise(1.0)
        * (1 + 0.75 * col("severity_broad_rate") + 1.25 * col("severity_primary_rate"))
        * (1 + 0.2 * col("in_operation_rate") + 0.3 * col("highway_rate") + 0.35 * col("high_speed_rate") + 0.6 * col("critical_event_near_operation_rate"))
        * (0.75 + F.greatest(F.least(col("avg_topic_strength"), F.lit(1.0)), F.lit(0.0))) * weight
    )
    return months.withColumn("watchlist_score", score)


def tier(complaints: Column, growth: Column, new: Column) -> Column:
    grown = F.coalesce(growth >= 2, F.lit(False))
    return F.when((complaints >= 10) & grown, TIERS[3]).when((complaints >= 5) & (grown | new), TIERS[2]).when(complaints >= COMPLAINTS_LEAST, TIERS[1]).otherwise(TIERS[0])


def tier_rank(name: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, t in enumerate(TIERS):
        out = out.when(name == t, i)
    return out.otherwise(0)


def _risk_reasons(df: DataFrame) -> list[Column]:
    col = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return [
        F.when(col("severity_broad_rate") >= RISK_SEVERITY, "high severity rate"),
        F.when(col("critical_event_near_operation_rate") >= RISK_CRITICAL, "critical event while in operation"),
        F.when(col("high_speed_rate") >= RISK_SPEED, "high-speed context"),
        F.when(col("avg_topic_strength") >= STRONG_MATCH, "strong topic match"),
    ]


def with_watch_reason(df: DataFrame) -> DataFrame:
    new = F.format_string("new/reemerging signal: %d complaints after zero prior 6-mo baseline", F.col("complaints").cast("long"))
    grown = F.concat(F.format_string("%.1f", F.bround("growth_vs_6mo_avg", 1)), F.lit("x 6-mo baseline"))
    return df.withColumn("watchlist_reason", F.concat_ws("; ", F.when(F.col("new_or_reemerging_signal"), new).otherwise(grown), *_risk_reasons(df)))


def with_monitor_reason(df: DataFrame) -> DataFrame:
    text = F.concat_ws("; ", *_risk_reasons(df))
    return df.withColumn("monitor_reason", F.when(text == "", "persistent risk context").otherwise(text))


def with_month_rank(df: DataFrame, cohort: list[str]) -> DataFrame:
    order = [F.col("watchlist_score").desc(), *[F.col(c).asc_nulls_last() for c in cohort]]
    return df.withColumn("month_rank", F.row_number().over(Window.partitionBy("month").orderBy(*order)))


def monthly_series(rows: DataFrame, cohort: list[str] | None = None, growth_least: float = GROWTH_LEAST) -> DataFrame:
    """The scored dense series of all cohorts, with the cohort's manufacturers joined in one text.

    The observed months are aggregated once, manufacturers along with them, and written; first months, calendar and names
    come from that small table. Names of rows without a month do not count.
    """
    cohort = cohort or COHORT
    months = materialize(cohort_months(rows, cohort, names="mfr_name"), "cohort-months")
    meta = months.groupBy(*cohort).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_names")))), " | ").alias("mfr_name"))
    series = add_score(add_emerging(add_growth(complete_months(months.drop("_names"), cohort), cohort), growth_least))
    on, right, gone = same_keys(series, meta, cohort, "_m_")
    return series.join(right, on, "left").drop(*gone)


def watchlist_views(series: DataFrame, cohort: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(emerging watchlist, risk monitor): defect cohorts of three complaints or more, ranked within their month."""
    cohort = cohort or COHORT
    monitor = series.filter((F.col("watchlist_group") == "defect_watchlist") & (F.col("complaints") >= COMPLAINTS_LEAST))
    watch = with_watch_reason(monitor.filter("emerging_signal_flag")).withColumn("signal_tier", tier(F.col("complaints"), F.col("growth_vs_6mo_avg"), F.col("new_or_reemerging_signal")))
    limits = {"severity_broad_rate": RISK_SEVERITY, "critical_event_near_operation_rate": RISK_CRITICAL, "high_speed_rate": RISK_SPEED}
    risky = reduce(lambda a, b: a | b, [F.col(c) >= least for c, least in limits.items() if c in series.columns])
    risk = with_monitor_reason(monitor.filter(~F.col("emerging_signal_flag") & risky))
    view = lambda df: with_month_rank(df, cohort).withColumn("yeartxt", format_year(F.col("yeartxt")))
    return view(watch), view(risk)


SUMMARY = ["month", "maketxt", "modeltxt", "yeartxt", "topic_id", "topic_label"]


def watchlist_summary(rows: DataFrame, watch: DataFrame) -> DataFrame:
    """Flagged component rows rolled up to cohort and topic; a complaint counts once, by its best-scoring component row."""
    keys = [*SUMMARY, "component_group"]
    left = rows.withColumn("yeartxt", format_year(F.col("yeartxt")))
    on, right, gone = same_keys(left, watch.select(*keys, "watchlist_score", "signal_tier"), keys)
    detail = left.join(right, on).drop(*gone)
    best = Window.partitionBy(*SUMMARY, "odino").orderBy(F.col("watchlist_score").desc(), "component_group")
    first = detail.withColumn("_one", F.row_number().over(best) == 1)
    only = lambda c: F.when(F.col("_one"), c)
    rate = lambda c: F.avg(only(F.col(c).cast("int")))
    out = first.groupBy(*SUMMARY).agg(
        sorted_distinct_text(F.col("mfr_name"), " | ").alias("mfr_name"),
        sorted_distinct_text(F.col("component_group"), " | ").alias("component_groups"),
        F.countDistinct("odino").alias("complaints"),
        F.countDistinct(only(F.col("state"))).alias("unique_states"),
        F.max("watchlist_score").alias("max_component_watchlist_score"),
        F.avg(only(F.col("topic_strength"))).alias("avg_topic_strength"),
        *[rate(flag).alias(r) for r, flag in RATES.items() if r != "in_operation_rate" and flag in rows.columns],
        F.max(tier_rank(F.col("signal_tier"))).alias("_rank"),
    )
    return out.withColumn("best_signal_tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_rank") + 1)).drop("_rank")


def recurring_signals(watch: DataFrame) -> DataFrame:
    """Cohorts flagged in several months: first and latest month, sizes, growth, tiers; half-even rounding."""
    keys = ["maketxt", "modeltxt", "yeartxt", "component_group", "topic_id", "topic_label"]
    out = watch.groupBy(*keys).agg(
        sorted_distinct_text(F.col("mfr_name"), " | ").alias("mfr_name"),
        F.countDistinct("month").alias("months_flagged"), F.min("month").alias("first_month"), F.max("month").alias("latest_month"),
        F.max("complaints").alias("max_complaints"), F.bround(F.avg("complaints"), 2).alias("avg_complaints"), F.bround(F.percentile("complaints", 0.5), 2).alias("median_complaints"),
        F.bround(F.max("growth_vs_6mo_avg"), 2).alias("max_growth_vs_6mo_avg"), F.bround(F.avg("avg_topic_strength"), 3).alias("avg_topic_strength"), F.bround(F.max("watchlist_score"), 3).alias("max_watchlist_score"),
        F.count_if(F.col("signal_tier") == TIERS[3]).alias("high_confidence_months"), F.count_if(F.col("signal_tier").isin(TIERS[2], TIERS[3])).alias("moderate_or_higher_months"),
        F.max(tier_rank(F.col("signal_tier"))).alias("_rank"),
    )
    return out.withColumn("best_signal_tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_rank") + 1)).drop("_rank")


def clue_terms(texts: DataFrame, watch: DataFrame, stop_words: list[str], top: int = 5) -> DataFrame:
    """Terms that mark each signal of the latest month: TF-IDF within the signal's documents, averaged over all of them.

    ``texts``: odino, month, cohort keys, text. Null keys do not match. A term needs two documents where the signal has five or more.
    """
    keys = ["maketxt", "modeltxt", "yeartxt", "component_group", "topic_id"]
    latest = watch.agg(F.max("month").alias("_last"))
    signals = watch.join(F.broadcast(latest), F.col("month") == F.col("_last")).select("month", *keys)
    docs = texts.withColumn("yeartxt", format_year(F.col("yeartxt"))).join(signals, ["month", *keys]).filter(F.col("text").isNotNull()).dropDuplicates(["month", *keys, "odino"])
    by = ["month", *keys]
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(stop_words) if stop_words else F.lit(True))
    counts = docs.select(*by, "odino", F.explode(words).alias("term")).groupBy(*by, "odino", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"))
    dfs = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    kept = dfs.join(sizes, by).filter(F.col("df") >= F.when(F.col("docs") >= 5, 2).otherwise(1))
    weighted = counts.join(kept, [*by, "term"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, "odino")))
    scored = weighted.withColumn("w", F.col("w") / norm).groupBy(*by, "term", "docs", "df").agg((F.sum("w") / F.first("docs")).alias("mean_weight"))
    ranked = scored.withColumn("clue_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("mean_weight", 9).desc(), "term")))
    return ranked.filter(F.col("clue_rank") <= top).select(*by, "clue_rank", "term", F.col("df").alias("document_support"), "docs", F.round("mean_weight", 6).alias("mean_weight"))
