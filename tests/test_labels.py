"""Report text, guards and parameter parsers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.functions import labels
from caseloom.quality import report


def test_columns(spark):
    df = spark.createDataFrame([(dt.date(2026, 2, 9), 0.2561, " a long label ", "x"), (None, None, None, " ")], "d date, x double, t string, u string")
    first, second = df.select(labels.month_label(F.col("d")), labels.percent(F.col("x")), labels.metric(F.col("x")), labels.shorten(F.col("t"), 9), labels.label_or_other(F.col("u"))).collect()
    assert tuple(first) == ("2026-02", "25.6%", "0.2561", "a long...", "x")
    assert tuple(second) == (None, None, "n/a", "", labels.OTHER)


def test_parsers():
    assert [labels.budget_label(f) for f in (0.01, 0.05, 0.1)] == ["top_1pct", "top_5pct", "top_10pct"]
    assert labels.number_list("1.5, 1,1.5,") == [1.5, 1.0]
    for text in ("", "0,1", "-1"):
        with pytest.raises(ValueError, match="above"):
            labels.number_list(text)


def test_guards(spark):
    labels.check_registry(2, {0: "a", 1: "b"}, {"watch": [1], "process": [0]})
    for names, groups in (({0: "a"}, {"w": [0, 1]}), ({0: "a", 1: "b"}, {"w": [0, 1], "p": [1]}), ({0: "a", 1: "b"}, {"w": [0]})):
        with pytest.raises(ValueError):
            labels.check_registry(2, names, groups)
    df = spark.createDataFrame([(dt.date(2026, 1, 1), None)], "a date, b date")
    report.require_dates(df, ["a"])
    with pytest.raises(ValueError, match=r"b \(1\)"):
        report.require_dates(df, ["a", "b"])


def test_report_text(spark):
    rows = spark.createDataFrame([("miles", f"check{i}", i) for i in range(4)] + [("city", "null", 3)], "field_name string, check_name string, value long")
    assert report.report_text(rows, 3) == "city: null 3\nmiles: check0 0, check1 1, check2 2, and 1 more"
