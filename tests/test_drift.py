"""Schema drift: renames by content, type changes, one consistent table."""

from __future__ import annotations

import json

from caseloom.quality import drift


def feed(spark, files):
    rows = [(i, name, json.dumps(r)) for name, records in files for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "line_no int, source_file string, payload string")
    order = spark.createDataFrame([(n, i + 1) for i, (n, _) in enumerate(files)], "file string, load_seq int")
    return df, order


def records(n, start=0, **fields):
    return [{"id": str(i), **{k: f(i) for k, f in fields.items()}} for i in range(start, start + n)]


def test_changes_and_unified_table(spark):
    one = records(60, hurt=lambda i: i % 3, fire=lambda i: "N" if i % 2 else "Y", km=lambda i: 1000 + i, deaths=lambda i: 0 if i % 10 else 1, note=lambda i: f"n{i}")
    two = records(60, 20, hurt_no=lambda i: str(i % 3), fire=lambda i: 0 if i % 2 else 1, km=lambda i: float(1000 + i), fatal=lambda i: (i + 3) % 7 == 0)
    df, order = feed(spark, [("a", one), ("b", two)])
    epochs, schemas, report = drift.feed_drift(df, order, record_key="id")
    got = {(r[0], r[3], r[4], r[5]) for r in report}
    assert got == {("b", "renamed", "hurt_no", "hurt"), ("b", "type_changed", "hurt_no", ""), ("b", "type_changed", "fire", ""), ("b", "type_changed", "km", ""), ("b", "added", "fatal", ""), ("b", "removed", "deaths", ""), ("b", "removed", "note", "")}
    columns = drift.unified_columns(schemas, report)
    assert columns["hurt"][0] == drift.WHOLE and columns["fire"][0] == drift.FLAG and columns["km"][0] == drift.DECIMAL
    table = drift.unified_table(df, epochs, "payload", "source_file", ["source_file", "line_no"], columns)
    row = table.filter("source_file = 'b' AND line_no = 0").first()
    assert (row["hurt"], row["fire"], row["km"], row["note"]) == (2, True, 1020.0, None)


def test_files_of_one_schema_are_one_epoch(spark):
    """What reaches the driver and the expression of the table grow with changes, not with files; unlisted files come last."""
    files = [(f"f{i:02d}", records(16, i * 8, **({"km": lambda i: 1000 + 7 * i} if i < 6 else {"miles": lambda i: str(1000 + 7 * i)}))) for i in range(12)]
    df, order = feed(spark, files)
    epochs, schemas, report = drift.feed_drift(df, order.filter("file <> 'f11'"), record_key="id")
    assert [(s.name, s.before) for s in schemas] == [("f00", None), ("f06", "f05")]
    assert {(r[0], r[3], r[4], r[5], r[8]) for r in report} == {("f06", "renamed", "miles", "km", "same records"), ("f06", "type_changed", "miles", "", None)}
    assert {r["file"]: r["epoch"] for r in epochs.collect()} == {f"f{i:02d}": 1 if i < 6 else 2 for i in range(12)}
    table = drift.unified_table(df, epochs, "payload", "source_file", ["source_file"], drift.unified_columns(schemas, report))
    assert table.columns == ["source_file", "id", "km"] and table.filter("km IS NULL").count() == 0 and dict(table.dtypes)["km"] == "bigint"


def test_rename_without_records_in_common(spark):
    df, order = feed(spark, [("a", records(80, vin=lambda i: f"ab{i % 7}")), ("b", records(80, 500, vin_no=lambda i: f"ab{i % 7}", other=lambda i: "zz zz"))])
    _, _, report = drift.feed_drift(df, order, record_key="id")
    assert {(r[3], r[4], r[5], r[8]) for r in report} == {("renamed", "vin_no", "vin", "distributions"), ("added", "other", "", None)}


def test_case_null_only_and_unreadable(spark):
    df, order = feed(spark, [("a", [{"id": "1", "x": None, "A": 1}]), ("b", [{"id": "1", "x": 1, "a": 1}])])
    df = df.union(spark.createDataFrame([(9, "b", "{broken")], df.schema))
    _, _, report = drift.feed_drift(df, order, record_key="id")
    got = {(r[3], r[4]) for r in report}
    assert ("type_changed", "x") not in got and {k for k, _ in got} <= {"added", "removed", "renamed"}


def test_names_that_differ_by_case_make_two_columns(spark):
    df, order = feed(spark, [("a", [{"id": "1", "x": "p"}]), ("b", [{"id": "2", "X": 5, "line_no": 3}])])
    epochs, schemas, report = drift.feed_drift(df, order, record_key="id")
    columns = drift.unified_columns(schemas, report)
    table = drift.unified_table(df, epochs, "payload", "source_file", ["source_file", "line_no"], columns)
    assert len({c.lower() for c in table.columns}) == len(table.columns) and {"x", "X_2", "payload_line_no"} <= set(table.columns)
    assert table.filter("source_file = 'b'").first()["X_2"] == 5


def test_type_lattice():
    assert drift.join_types(None, drift.WHOLE) == drift.WHOLE
    assert drift.join_types(drift.WHOLE, drift.DECIMAL) == drift.DECIMAL
    assert drift.join_types(drift.FLAG, drift.WHOLE) == drift.TEXT


def test_empty_feed(spark):
    df, order = feed(spark, [])
    assert drift.feed_drift(df, order, record_key="id")[2] == []
