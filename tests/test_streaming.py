"""Streaming forms agree with batch."""

from __future__ import annotations

import datetime as dt

from caseloom.streaming import cohorts


def test_daily_counts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 12)
    rows = [(base + dt.timedelta(days=d), "ab"[d % 2]) for d in range(10) for _ in range(d + 1)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = cohorts.read_stream(spark, str(tmp_path / "in"), df.schema)
    cohorts.run_to_table(cohorts.daily_counts(stream, "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    days = spark.read.parquet(str(tmp_path / "out"))
    got = {r["day"].day: r["n"] for r in days.collect()}
    assert got and all(n == d for d, n in got.items()) and max(got) <= 8  # the last days are still open
    assert cohorts.months_of(days, ["k"]).count() == 2


def test_first_deliveries(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, i), str(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    cohorts.run_to_table(cohorts.first_deliveries(cohorts.read_stream(spark, str(tmp_path / "in"), df.schema), "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
