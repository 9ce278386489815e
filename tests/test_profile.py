"""Footer-first profile: counts agree with a plain scan however chunks are decided."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from caseloom.quality import profile

RULES = {"miles": profile.FieldRule("[0-9]{1,7}", histogram=True), "deaths": profile.FieldRule("[0-9]{1,2}")}


def write(path, rows, **kw):
    table = pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("load", "key", "miles", "deaths"))})
    pq.write_table(table, path, **kw)


def shares(spark, path):
    counts = profile.value_counts_by_load(spark.read.parquet(str(path)), RULES, "load", "key")
    return {(r["load_value"], r["field"]): (r["rows"], r["missing"], r["zeros"], r["malformed"]) for r in profile.load_shares(counts).collect()}


def brute(rows):
    import re

    out = {}
    for load, _, miles, deaths in rows:
        for field, value, pattern in (("miles", miles, "[0-9]{1,7}"), ("deaths", deaths, "[0-9]{1,2}")):
            c = out.setdefault((load, field), [0, 0, 0, 0])
            c[0] += 1
            t = value.strip(" ") if value is not None else ""
            if not t:
                c[1] += 1
            elif not re.fullmatch(pattern, t):
                c[3] += 1
            elif int(t) == 0:
                c[2] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("kw", [{}, {"use_dictionary": False}, {"data_page_version": "2.0"}, {"compression": "zstd", "row_group_size": 7}, {"compression": "none"}])
def test_shares_equal_a_plain_scan(spark, tmp_path, kw):
    rows = [(f"l{i % 3}", str(i), [None, " ", "0", "12", "12x", " 7 ", "99999999", "1\n"][i % 8], ["1", None, "00", "abc"][i % 4]) for i in range(60)]
    rows.sort(key=lambda r: r[0])
    write(tmp_path / "a.parquet", rows, **kw)
    assert shares(spark, tmp_path / "a.parquet") == brute(rows)


def test_chunks_are_decided_without_a_scan(spark, tmp_path):
    clean = [("l1", str(i), "5", ["1", "2", None][i % 3]) for i in range(30)]
    dirty = [("l1", str(i), "5", ["0", "x"][i % 2]) for i in range(30)]
    write(tmp_path / "clean.parquet", clean)
    write(tmp_path / "dirty.parquet", dirty)
    df = spark.read.parquet(str(tmp_path))
    chunks = {(r["file"].rsplit("/", 1)[1], r["field"]): r["decided"] for r in profile.decide_chunks(profile.chunk_table(df, list(RULES), "load"), RULES).collect()}
    assert chunks == {("clean.parquet", "deaths"): True, ("clean.parquet", "miles"): True, ("dirty.parquet", "deaths"): False, ("dirty.parquet", "miles"): True}  # one candidate only: its count is known
    assert shares(spark, tmp_path) == brute(clean + dirty)


def test_findings_and_medians(spark, tmp_path):
    rows = [("a", f"a{i}", str(10 + i), "0") for i in range(10)] + [("b", f"b{i}", str(30 + i) if i else "bad", "0" if i > 1 else None) for i in range(10)]
    write(tmp_path / "x.parquet", rows)
    counts = profile.value_counts_by_load(spark.read.parquet(str(tmp_path / "x.parquet")), RULES, "load", "key")
    loads = spark.createDataFrame([("a", 1), ("b", 2)], "load_value string, load_seq int")
    got = {tuple(r) for r in profile.load_findings(counts, loads, ["miles"]).collect()}
    assert got == {("violation", "miles", "b", "b0"), ("null_share", "deaths", "b", ""), ("zero_share", "deaths", "b", ""), ("violation_share", "miles", "b", ""), ("median", "miles", "b", "")}
    assert {(r[0], r[1]): r[2] for r in profile.load_medians(counts, ["miles"]).collect()} == {("a", "miles"): 29, ("b", "miles"): 70}


def test_empty_table(spark, tmp_path):
    write(tmp_path / "e.parquet", [])
    assert shares(spark, tmp_path / "e.parquet") == {}
