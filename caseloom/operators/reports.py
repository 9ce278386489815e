"""Report tables: leaderboards, latest partitions, shares, urgency bands, share shifts, seed summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.evaluation import score_counts

BANDS = ((0.01, "critical"), (0.05, "high"), (0.10, "elevated"))


def latest(df: DataFrame, month: str = "month") -> DataFrame:
    """Rows of the last month; the month is a one-row side."""
    last = df.agg(F.max(month).alias("_last"))
    return df.join(F.broadcast(last), F.col(month) == F.col("_last")).drop("_last")


def leaderboard(summary: DataFrame, score: str, n: int = 12, ties: tuple[str, ...] = ()) -> DataFrame:
    """The top n of the latest month by score, then complaints, then the tie columns."""
    return latest(summary).orderBy(F.col(score).desc(), F.col("complaints").desc(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def topic_mix(summary: DataFrame, n: int = 10) -> DataFrame:
    """Complaints and cohorts per topic in the latest month, the n largest."""
    return latest(summary).groupBy("topic_id").agg(F.sum("complaints").alias("complaints"), F.count(F.lit(1)).alias("cohorts")).orderBy(F.col("complaints").desc(), "topic_id").limit(n)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a full order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """Rows, share and cumulative share per label, most frequent first (one row per label)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("n_rows").desc(), label).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n_rows").over(Window.partitionBy())
    return counts.withColumns({"share": F.round(F.col("n_rows") / total, 6), "cumulative_share": F.round(F.sum("n_rows").over(order) / total, 6)})


def share_shift(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Share of each label in two frames and the change in percent; labels of either side, absent ones with share 0."""
    side = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias(f"_{name}")).withColumn(name, F.col(f"_{name}") / F.sum(f"_{name}").over(Window.partitionBy())).drop(f"_{name}")
    both = side(before, "before_share").join(side(after, "after_share"), label, "full").fillna(0.0, ["before_share", "after_share"])
    return both.withColumn("share_percent_change", F.round(100 * (F.col("after_share") - F.col("before_share")) / F.nullif(F.col("before_share"), F.lit(0.0)), 6)).withColumns({c: F.round(c, 6) for c in ("before_share", "after_share")})


def urgency_bands(df: DataFrame, score: str, truth: str, key: str, by: list[str]) -> DataFrame:
    """Rows with ``percent_rank`` (place from the top by score, ties by key, over all rows of the group) and ``band``.

    Places come from counts per distinct score; only rows of equal score are numbered by a window.
    """
    ranks = score_counts(df, score, truth, by).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("score").alias("_s"), "above_n", "total_n")
    on = [df[c].eqNullSafe(ranks[f"_k_{c}"]) for c in by] + [df[score] == ranks["_s"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = df.join(ranks, cond).withColumn("_r", F.row_number().over(Window.partitionBy(*by, score).orderBy(key)) + F.col("above_n"))
    place = F.col("_r") / F.col("total_n")
    band = F.when(F.lit(False), "")
    for upto, name in BANDS:
        band = band.when(place <= upto, name)
    return joined.withColumns({"percent_rank": F.round(place, 9), "band": band.otherwise("routine")}).drop("_s", "_r", "above_n", "total_n", *[f"_k_{c}" for c in by])


def seed_summary(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation and median of metrics over seeds."""
    return runs.groupBy(*by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.percentile(m, 0.5).alias(f"{m}_median"))])


def metric_row(metrics: DataFrame, model: str, split: str) -> dict:
    """The one row of a model and split; an error if there is none."""
    row = metrics.filter((F.col("model") == model) & (F.col("split") == split)).first()
    if row is None:
        raise ValueError(f"no metrics of {model} on {split}")
    return row.asDict()


def topic_library(topics: DataFrame, texts: DataFrame, key: str, cut: str, examples: int = 3, width: int = 280) -> DataFrame:
    """Per topic: share before and after the cut, median strength, and distinct example texts, strongest first."""
    rows = topics.join(texts.select(key, "ldate", "text"), key)
    early = F.col("ldate") < F.lit(cut).cast("date")
    totals = rows.agg(F.count_if(early).alias("_d"), F.count_if(~early).alias("_f"))
    stats = rows.groupBy("topic_id").agg(F.count_if(early).alias("d"), F.count_if(~early).alias("f"), F.percentile("topic_strength", 0.5).alias("median_topic_weight"))
    stats = stats.crossJoin(F.broadcast(totals)).select("topic_id", F.round(F.col("d") / F.greatest("_d", F.lit(1)), 6).alias("development_share"), F.round(F.col("f") / F.greatest("_f", F.lit(1)), 6).alias("forward_share"), "median_topic_weight")  # one-row side
    short = rows.select("topic_id", F.substring("text", 1, width).alias("example"), "topic_strength").groupBy("topic_id", "example").agg(F.max("topic_strength").alias("s"))
    best = short.withColumn("_r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("s").desc(), "example"))).filter(F.col("_r") <= examples)
    return stats.join(best.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("_r", "example")))["example"].alias("examples")), "topic_id", "left")
