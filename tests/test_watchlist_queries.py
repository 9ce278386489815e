"""The watchlist queries over the whole cohort: make, model, year, component and topic."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from caseloom.plans.relational import QUERIES
from caseloom.plans.relational_sql import _COARSE, _SERIES, SQL
from tests.test_entry import cell

CASES = "odino string, mfr_name string, maketxt string, modeltxt string, yeartxt int, state string, ldate date, component_groups string, severity_broad_flag boolean, severity_primary_flag boolean"
GROUP = "ENGINE"  # topic 9, a defect topic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """March: three complaints on a null model, three on a null year, two on each of two models; CAMRY is severe month after month."""
    rows = []

    def add(model, year, month, n, severe=False):
        for i in range(n):
            rows.append((f"{len(rows):04d}", "MFR", "MAKE", model, year, "TX" if i % 2 else "CA", dt.date(2024, month, 5 + i), GROUP, severe, severe))

    for month in (1, 2, 3, 4, 5):
        add("CAMRY", 2021, month, 3, severe=True)
    add(None, 2020, 3, 3)
    add("CIVIC", None, 3, 3)
    add("ALPHA", 2020, 3, 2)
    add("BETA", 2020, 3, 2)
    add("CIVIC", 2019, 5, 5)
    out = tmp_path_factory.mktemp("cohorts")
    spark.createDataFrame(rows, CASES).coalesce(1).write.parquet(str(out / "odi_component_multilabel_cases.parquet"))
    texts = [(r[0], "gearbox slips" if r[3] is None else "lamp fails") for r in rows]
    spark.createDataFrame(texts, "odino string, cdescr string").coalesce(1).write.parquet(str(out / "odi_severity_cases.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["emerging_watchlist", "risk_monitor", "recurring_signals", "signal_flow"])
def test_full_equals_sql_over_the_whole_cohort(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW odi_component_multilabel_cases AS SELECT * FROM '{folder}/odi_component_multilabel_cases.parquet/*.parquet'")
    assert _COARSE in SQL[name]
    want = con.execute(SQL[name].replace(_COARSE, _SERIES))
    names = [d[0] for d in want.description]
    got = QUERIES[f"{name}_full"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(cell(r[c]) for c in names) for r in got.collect()), key=str)
    assert rows and rows == sorted((tuple(cell(x) for x in r) for r in want.fetchall()), key=str)


def test_single_models_and_null_keys(spark, folder):
    flagged = {(r["modeltxt"], r["yeartxt"], r["month"], r["complaints"]) for r in QUERIES["emerging_watchlist_full"](spark, folder).collect()}
    assert {(None, "2020", "2024-03-01", 3), ("CIVIC", "Unknown", "2024-03-01", 3), ("CIVIC", "2019", "2024-05-01", 5)} <= flagged
    assert not {m for m, *_ in flagged} & {"ALPHA", "BETA"}
    summary = {(r["modeltxt"], r["yeartxt"], r["month"]): r["complaints"] for r in QUERIES["watchlist_summary"](spark, folder).collect()}
    assert summary[(None, "2020", "2024-03-01")] == 3 and summary[("CIVIC", "2019", "2024-05-01")] == 5


def test_clue_terms_of_one_model(spark, folder):
    clues = {(r["modeltxt"], r["yeartxt"], r["month"], r["docs"]) for r in QUERIES["clue_terms"](spark, folder).collect()}
    assert clues == {("CIVIC", "2019", "2024-05-01", 5)}
