"""The early-warning engine on the documented cohort set."""

from __future__ import annotations

import datetime as dt

from caseloom.operators import watchlist as W

KEYS = "odino string, mfr_name string, maketxt string, modeltxt string, yeartxt int, state string, month date, component_groups string, topic_id int, topic_label string, topic_category string, watchlist_group string, topic_strength double, severity_broad_flag boolean"


def months(first, n):
    y, m = first
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


def data(spark):
    rows, n = [], 0

    def add(model, year, month, groups, state, broad):
        nonlocal n
        n += 1
        rows.append((f"{n:05d}", "MFR", "MAKE", model, year, state, month, groups, 1, "t", "defect", "defect_watchlist", 0.5, broad))

    for m in months((2024, 2), 12):
        add("F-150", 2017, m, "POWER TRAIN|ELECTRICAL SYSTEM", "TX", False)
    for s in ("TX", "CA", "FL", "GA", "NC"):
        add("F-150", 2017, dt.date(2025, 2, 1), "POWER TRAIN|ELECTRICAL SYSTEM", s, False)
    for m in months((2024, 1), 12):
        add("CIVIC", 2020, m, "STEERING", "TX", False)
    for m in months((2024, 8), 7):
        for s in ("MI", "OH", "PA"):
            add("CAMRY", 2021, m, "STEERING", s, True)
    return W.explode_groups(spark.createDataFrame(rows, KEYS))


def test_views(spark):
    rows = data(spark)
    series = W.monthly_series(rows)
    watch, risk = W.watchlist_views(series)
    flagged = {(r["modeltxt"], r["component_group"], r["month"]): r for r in watch.collect()}
    truck = flagged[("F-150", "POWER TRAIN", dt.date(2025, 2, 1))]
    assert (truck["rolling_6mo_avg"], truck["growth_vs_6mo_avg"], truck["growth_delta_6mo"], truck["new_or_reemerging_signal"], truck["signal_tier"]) == (1.0, 5.0, 4.0, False, "Moderate signal")
    assert truck["watchlist_reason"].startswith("5.0x 6-mo baseline")
    early = [k[2] for k, r in flagged.items() if k[0] == "CAMRY" and r["signal_tier"] == "Early signal"]
    assert sorted(early) == months((2024, 8), 3)
    assert not any(k[0] == "CIVIC" for k in flagged)
    assert sorted(r["month"] for r in risk.filter("modeltxt = 'CAMRY'").collect()) == months((2024, 11), 4)
    summary = {(r["modeltxt"], r["month"]): r for r in W.watchlist_summary(rows, watch).collect()}
    s = summary[("F-150", dt.date(2025, 2, 1))]
    assert (s["complaints"], s["unique_states"], s["component_groups"], s["best_signal_tier"]) == (5, 5, "ELECTRICAL SYSTEM | POWER TRAIN", "Moderate signal")
    recurring = {r["modeltxt"]: r for r in W.recurring_signals(watch).filter("component_group = 'STEERING'").collect()}
    assert recurring["CAMRY"]["months_flagged"] == 3 and recurring["CAMRY"]["moderate_or_higher_months"] == 0


def test_null_cohort_keys_stay_one_cohort(spark):
    rows = data(spark).withColumn("modeltxt", W.F.lit(None).cast("string"))
    grid = W.monthly_series(rows)
    assert grid.filter("complaints > 0").agg(W.F.sum("complaints")).first()[0] == rows.select("odino", "component_group").distinct().count()


def test_clue_terms(spark):
    rows = data(spark)
    watch, _ = W.watchlist_views(W.monthly_series(rows))
    texts = rows.withColumn("text", W.F.when(W.F.col("component_group") == "POWER TRAIN", "gearbox slips the hill").otherwise("lamp out the hill"))
    out = W.clue_terms(texts, watch, ["the"]).filter("component_group = 'POWER TRAIN'").collect()
    assert {r["term"] for r in out} == {"gearbox", "slips", "hill"} and all(r["document_support"] == 5 for r in out)


def test_empty(spark):
    none = spark.createDataFrame([], KEYS.replace("component_groups", "component_group"))
    watch, risk = W.watchlist_views(W.monthly_series(none))
    assert watch.count() == risk.count() == 0
