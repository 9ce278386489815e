"""The driver contract: every query of the core runs, and equals its SQL where it has one."""

from __future__ import annotations

import html
import re
import unicodedata
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from caseloom.functions import text as X
from caseloom.plans import general, relational

QUERIES = {**general.QUERIES, **relational.QUERIES}
SQL = {**general.SQL, **relational.SQL}


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "int64", "int32", "float64"):
        return f"{float(x):.9g}"
    return str(x)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=str)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    expected = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert rows == expected


def rows_of(spark, sf, name):
    return sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)


def test_queries_without_sql_are_known():
    """Each of these is checked below or, for models, in its own test."""
    assert set(QUERIES) - set(SQL) == {"p2_chunks", "p3_found", "p3_report", "p3_table", "p7_found", "p7_items", "clue_terms", "topic_text", "severity_text", "topics", "severity_model"}


def test_drift_queries(spark, sf, con):
    report = QUERIES["p3_report"](spark, sf).collect()
    assert rows_of(spark, sf, "p3_found") == sorted(((r["source_file"], r["change_kind"], r["field_name"], r["old_name"]) for r in report), key=str)
    assert {r["change_kind"] for r in report} == {"added", "removed", "renamed", "type_changed"} and all((r["evidence"] is not None) == (r["change_kind"] == "renamed") for r in report)
    table = QUERIES["p3_table"](spark, sf)
    feed = con.execute("SELECT feed_id, json_extract_string(payload, '$.cmplid') FROM complaint_feed").fetchall()
    assert sorted(map(tuple, table.select("feed_id", "cmplid").collect())) == sorted(feed)


def test_packed_queries(spark, sf, con):
    items = QUERIES["p7_items"](spark, sf).collect()
    several = rows_of(spark, sf, "p7_found")
    places = {}
    for table, key, pos, text in several:
        assert text and text == text.strip()
        places.setdefault((table, key), []).append(pos)
    assert all(len(p) >= 2 and set(p) == set(range(1, max(p) + 1)) for p in places.values())
    assert {t for t, *_ in several} == {"complaints", "odi_component_multilabel_cases"} and len(items) > len(several)


def test_text_queries(spark, sf, con):
    """The same steps with another engine, over every narrative."""
    cases = {r[0]: r[1:] for r in con.execute("SELECT odino, cdescr, maketxt, modeltxt, yeartxt FROM odi_severity_cases").fetchall()}
    got = QUERIES["topic_text"](spark, sf).collect()
    assert len(got) == len(cases) == QUERIES["severity_text"](spark, sf).filter("model_text IS NOT NULL").count()
    for r in got:
        text, *names = cases[r["odino"]]
        if text is None:
            assert r["topic_text"] is None
            continue
        t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(text)).replace("\0", " ")).strip()
        t = re.sub("â€™|â€˜|`", "'", t)
        for short, full in X.CONTRACTIONS:
            ending = short == "n't" or short.startswith("'")
            t = re.sub(re.escape(short) if ending else rf"\b{re.escape(short)}\b", full, t, flags=re.I)
        t = re.split(X.BOILERPLATE_START, t, maxsplit=1)[0]
        for pattern in (X.UPDATED, X.LEADING_MARKER, X.TRAILING_MARKER, *X.PERSONAL):
            t = re.sub(pattern, " ", t)
        for _ in range(2):
            for pattern in X.OFFICE_RULES:
                t = re.sub(pattern, " ", t)
            t = re.sub(r"\s+", " ", t).strip()
        t = re.sub(r"[^a-z0-9\s-]", " ", re.sub(X.UNITS, r"\1 \2", t.lower()))
        for name in names:
            n = str(name).lower().strip() if name is not None else ""
            if n and n != "nan":
                t = re.sub(rf"\b{re.escape(n)}\b", " ", t)
        assert r["topic_text"] == re.sub(r"\s+", " ", t).strip(), text


def test_clue_terms_and_chunks(spark, sf):
    clues = QUERIES["clue_terms"](spark, sf)
    assert clues.count() == clues.distinct().count()
    chunks = {r["field_name"]: r for r in QUERIES["p2_chunks"](spark, sf).collect()}
    assert set(chunks) == {"miles", "veh_speed", "yeartxt", "deaths"} and all(r["chunks"] >= r["decided_chunks"] >= 0 for r in chunks.values())
