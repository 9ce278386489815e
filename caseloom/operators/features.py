"""Case features, split policies and model frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import columns as C
from caseloom.operators.history import prior_history

# The split policies as half-open upper ends in order.
SPLITS = {
    "benchmark_v1": (("train", "2025-01-01"), ("valid_2025", "2026-01-01"), ("holdout_2026", None)),
    "feature_wave1": (("train_core", "2024-01-01"), ("screen_2024", "2025-01-01"), ("select_2025", "2026-01-01"), ("holdout_2026", None)),
    "topic": (("development", "2025-01-01"), ("forward", None)),
}
UNIONS = {"dev_2020_2024": ("train_core", "screen_2024"), "dev_2020_2025": ("train_core", "screen_2024", "select_2025")}
MISSING = "__MISSING__"


def split_policy(mode: str) -> tuple[tuple[str, str | None], ...]:
    if mode not in SPLITS:
        raise ValueError(f"unknown split mode {mode!r}; known: {', '.join(sorted(SPLITS))}")
    return SPLITS[mode]


def split_column(day: Column, mode: str) -> Column:
    """The split of a date; null for a null date."""
    out = F.when(day.isNull(), None)
    for name, end in split_policy(mode):
        out = out.otherwise(name) if end is None else out.when(day < F.lit(end).cast("date"), name)
    return out


def in_split(name: str, split: str = "split") -> Column:
    """Rows of a split or of a union of splits."""
    return F.col(split).isin(*UNIONS.get(name, (name,)))


def split_summary(cases: DataFrame, mode: str, target: str, day: str = "ldate", key: str = "odino") -> DataFrame:
    """Rows, distinct cases, date range and distinct targets per split."""
    return cases.withColumn("split", split_column(F.col(day), mode)).filter("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("cases"), F.min(F.to_date(day)).alias("first_date"), F.max(F.to_date(day)).alias("last_date"), F.countDistinct(target).alias("targets"))


def guard_splits(summary: DataFrame, needed: list[str]) -> None:
    """Raises unless every needed split has rows and more than one target."""
    seen = {r["split"]: r for r in summary.collect()}
    bad = [s for s in needed if s not in seen or seen[s]["targets"] < 2]
    if bad:
        raise ValueError(f"splits without rows or with one class only: {', '.join(bad)}")


def age_features(cases: DataFrame, day: str = "ldate", year: str = "yeartxt") -> DataFrame:
    age = C.vehicle_age(F.col(day), F.col(year))
    return cases.withColumns({"complaint_year": F.year(day), "complaint_month": F.month(day), "complaint_quarter": F.quarter(day), "vehicle_age": age, "vehicle_age_bucket": C.age_bucket(age)})


def requested_features(cases: DataFrame, wanted: list[str]) -> DataFrame:
    """Adds only the derived features asked for that are not there yet."""
    missing = [c for c in wanted if c not in cases.columns]
    if any(c.startswith(("complaint_", "vehicle_age")) for c in missing):
        cases = age_features(cases)
    if "state_region" in missing:
        cases = cases.withColumn("state_region", C.region(F.col("state")))
    if any(c.startswith("prior_") for c in missing):
        cases = prior_history(cases)
    unknown = [c for c in wanted if c not in cases.columns]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return cases


def classify_columns(df: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """Features by kind: flags (boolean or named *_flag), numbers, categories; duplicates dropped in order."""
    kinds = dict(df.dtypes)
    out: dict[str, list[str]] = {"cat": [], "num": [], "flag": []}
    for c in dict.fromkeys(features):
        kind = "flag" if kinds[c] == "boolean" or c.endswith("_flag") else "cat" if kinds[c] == "string" else "num"
        out[kind].append(c)
    return out


def compose_features(base: list[str], add: list[str] = (), remove: list[str] = ()) -> list[str]:
    unknown = [c for c in remove if c not in base]
    if unknown:
        raise ValueError(f"cannot remove what is not there: {', '.join(unknown)}")
    return [c for c in dict.fromkeys([*base, *add]) if c not in set(remove)]


def model_frame(cases: DataFrame, features: list[str], target: str, key: str = "odino", missing: str = MISSING) -> DataFrame:
    """Categories as text with a missing mark, numbers and flags as doubles, keyed; sort by (date, id) only where a sink needs it."""
    kinds = classify_columns(cases, features)
    return cases.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in kinds["cat"]], *[F.col(c).cast("double").alias(c) for c in [*kinds["num"], *kinds["flag"]]], F.col(target).alias("target"))


def unseen_labels(train: DataFrame, later: DataFrame, label: str) -> DataFrame:
    """Labels of the later frame that training never saw."""
    return later.select(label).filter(F.col(label).isNotNull()).distinct().join(train.select(label).distinct(), label, "left_anti")
