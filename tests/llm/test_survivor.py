"""Duplicate groups: pairs against brute force, winners by votes."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from collections import Counter

import pytest

from caseloom.llm import survivor

KNOWN = ["AIR BAGS", "FUEL SYSTEM, GASOLINE"]
SOURCES = [("old", dt.datetime(2020, 1, 1)), ("new", dt.datetime(2024, 1, 1))]
SCHEMA = "cmplid string, odino string, compdesc string, miles string, veh_speed string, source_file string, votes string"
ROWS = [
    ("1", "10,001", "AIR BAGS; FUEL SYSTEM, GASOLINE", "100", None, "old", "x"),
    ("2", "ODI-10001", '"air bags"|Fuel  System, Gasoline', "250", " ", "new", None),
    ("3", "0010001", "AIR BAGS / FUEL SYSTEM, GASOLINE |", "100.0", "40", "old", "x"),
    ("3", "0010001", "AIR BAGS / FUEL SYSTEM, GASOLINE |", "100.0", "40", "old", "x"),
    ("4", "10001.0", "FUEL SYSTEM, GASOLINE; AIR BAGS", None, None, "new", None),
    ("5", None, "AIR BAGS", "1", "1", "new", None),
    ("6", None, "AIR BAGS", "1", "1", "new", None),
    ("7", "10002", None, "1", "1", "new", None),
    ("8", "10002", "", "1", "1", "new", None),
]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(SOURCES, "source_file string, delivered_at timestamp")


def weigh(df, sources, trust=()):
    table = df.sparkSession.createDataFrame(list(trust), "_src string, trust double")
    return survivor.load_weights(sources, table)


def pairs(df, sources):
    return sorted(tuple(r) for r in survivor.duplicate_pairs(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources)).collect())


def test_pairs(frames):
    assert pairs(*frames) == [("1", "2"), ("1", "3"), ("2", "3")]


def test_a_large_group_gives_every_pair(spark, frames):
    many = spark.createDataFrame([(f"{i:03d}", "77", "AIR BAGS", None, None, "old", None) for i in range(120)], SCHEMA)
    assert pairs(many, frames[1]) == list(itertools.combinations([f"{i:03d}" for i in range(120)], 2))


def test_survivor(frames):
    df, sources = frames
    patterns = {"miles": "[0-9]{1,7}"}
    got = survivor.survivors(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources), patterns).collect()
    assert len(got) == 1
    row = got[0]
    # one recent vote outweighs two old ones of five half-lives' age; speed has one stated value; the odd column has one
    assert (row["miles"], row["veh_speed"], row["votes"], row["n_rows"], row["source_file"]) == ("250", "40", "x", 4, "new")
    trusted = survivor.survivors(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources, [("old", 1000.0)]), patterns).first()
    assert trusted["miles"] in ("100", "100.0")


def test_violations_count_little(spark, frames):
    df = spark.createDataFrame([("1", "5", "AIR BAGS", "??", None, "new", None), ("2", "5", "AIR BAGS", "9", None, "old", None)], SCHEMA)
    assert survivor.survivors(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, frames[1]), {"miles": "[0-9]{1,7}"}).first()["miles"] == "9"


def test_empty(spark, frames):
    none = frames[0].limit(0)
    assert pairs(none, frames[1]) == []
    assert survivor.survivors(none, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(none, frames[1]), {}).count() == 0


def test_memberships(frames):
    df, sources = frames
    got = survivor.memberships(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources)).collect()
    assert sorted((r["cmplid"], r["representative"], r["n_records"]) for r in got) == [("1", "2", 3), ("2", "2", 3), ("3", "2", 3)]
    trusted = survivor.memberships(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources, [("old", 1.0), ("new", 0.001)])).collect()
    assert {r["representative"] for r in trusted} == {"3"}


def test_trust_is_the_share_of_good_values(spark):
    df = spark.createDataFrame([("a", "1", " 20 "), ("a", None, "x"), ("b", "", "??"), (None, "3", "4")], "source_file string, miles string, veh_speed string")
    got = {r["_src"]: r["trust"] for r in survivor.load_trust(df, "source_file", {"miles": "[0-9]+", "veh_speed": "[0-9]+"}).collect()}
    assert got == {"a": 0.5, "b": 0.0, None: 1.0}


def test_fractions_are_values_of_their_own(spark):
    df = spark.createDataFrame([("10.2",), ("10.9",), ("10.20",), ("1,000",), ("1000.0",), ("0",), ("x",)], "v string")
    assert [r[0] for r in df.select(survivor.normalised("miles", df.v, {}, ("miles",))).collect()] == ["10.2", "10.9", "10.2", "1000", "1000", "0", "X"]


def test_winners_against_brute_force(spark):
    """Votes of random rows by trust and age, counted again in plain Python."""
    rng = random.Random(3)
    loads = [(f"s{i}", dt.datetime(2018 + i, 1, 1)) for i in range(5)]
    trust = [(f"s{i}", 0.2 + 0.15 * i) for i in range(5)]
    rows = sorted({(str(i), str(rng.randrange(25)), "AIR BAGS", rng.choice(["10", "20", "30", None, "zz"]), None, rng.choice(loads)[0], None) for i in range(160)}, key=str)
    df, sources = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(loads, "source_file string, delivered_at timestamp")
    got = {r["odino"]: r["miles"] for r in survivor.survivors(df, "cmplid", "odino", "compdesc", KNOWN, "source_file", weigh(df, sources, trust), {"miles": "[0-9]+"}).collect()}
    newest, weight = max(loads, key=lambda x: x[1])[1], dict(trust)
    votes: dict = {}
    for _, number, _, miles, _, source, _ in rows:
        if miles:
            at = dict(loads)[source]
            cell = votes.setdefault(number, {}).setdefault(miles.upper(), [0.0, at])
            cell[0] += weight[source] * 0.5 ** ((newest - at).days / survivor.HALF_LIFE_DAYS) * (1 if miles.isdigit() else survivor.VIOLATION_WEIGHT)
            cell[1] = max(cell[1], at)
    sizes = Counter(r[1] for r in rows)
    want = {n.lstrip("0") or n: max(v, key=lambda m: (round(v[m][0], 9), v[m][1], m)) for n, v in votes.items() if sizes[n] > 1 and n.strip("0")}
    assert {n: (m or "").upper() or None for n, m in got.items() if n in want} == want
