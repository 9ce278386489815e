"""Every query of the subpackage runs; those with SQL agree with it; keys are clean."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from caseloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_nothing_else_imports_the_subpackage():
    root = Path(queries.__file__).resolve().parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "caseloom.llm" in p.read_text()]
