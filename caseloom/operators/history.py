"""Leakage-free prior history: what was known about a key before an event's day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_SETS = {"make_model": ["maketxt", "modeltxt"], "mfr": ["mfr_name"], "make_model_year": ["maketxt", "modeltxt", "yeartxt"]}


def prior_history(cases: DataFrame, day: str = "ldate", target: str = "severity_primary_flag", key_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds per key set the number of earlier cases and the share of severe ones among them.

    Cases are first reduced to daily counts per key, then accumulated over days strictly before; cases of the same day do not see
    each other. Null keys form a key of their own, a null day comes last and sees everything dated; the share is null without history.
    """
    out = cases
    for name, keys in (key_sets or KEY_SETS).items():
        daily = cases.groupBy(*keys, F.to_date(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(target)).alias("_s"))
        before = Window.partitionBy(*keys).orderBy(F.col("_d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        known = daily.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"prior_count_{name}"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_severe"))
        on = reduce(lambda a, b: a & b, [out[k].eqNullSafe(known[f"_k{i}"]) for i, k in enumerate(keys)]) & F.to_date(out[day]).eqNullSafe(known["_d"])
        out = out.join(known, on, "left").withColumn(f"prior_share_{name}", F.col("_severe") / F.nullif(F.col(f"prior_count_{name}"), F.lit(0))).drop("_d", "_severe", *[f"_k{i}" for i in range(len(keys))])
    return out
