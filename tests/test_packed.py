"""Packed values: known values protect their delimiters, the rest is cut."""

from __future__ import annotations

import itertools
import random

import pytest

from caseloom.operators.packed import Segmenter, packed_items

KNOWN = ["AIR BAGS", "FUEL SYSTEM, GASOLINE", "VISIBILITY/WIPER", "ENGINE / COOLING", 'TRAILER HITCH, 5TH-WHEEL "GOOSENECK"', "SEATS", "SEATS, POWERED", "WHEELS:LUGS, NUTS, BOLTS"]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("FUEL SYSTEM, GASOLINE, AIR BAGS", ["FUEL SYSTEM, GASOLINE", "AIR BAGS"]),
        ("seats, powered / ENGINE / COOLING", ["seats, powered", "ENGINE / COOLING"]),
        ("SEATS; powered gate", ["SEATS", "powered gate"]),
        ('"AIR BAGS"|"ROOF, RACK"', ["AIR BAGS", "ROOF, RACK"]),
        ('"TRAILER HITCH, 5TH-WHEEL ""GOOSENECK""" + AIR BAGS', ['TRAILER HITCH, 5TH-WHEEL "GOOSENECK"', "AIR BAGS"]),
        ("A | | B ||", ["A", "B"]),
        ("SUN/ROOF / /KEY FOB~X", ["SUN/ROOF", "KEY FOB", "X"]),
        ("WHEELS : LUGS, NUTS,  BOLTS\nAIR BAGS", ["WHEELS : LUGS, NUTS,  BOLTS", "AIR BAGS"]),
        ("'AIR BAGS','SEATS'", ["AIR BAGS", "SEATS"]),
        ("", []),
        ("  \t ", []),
        ('it"s', ['it"s']),
    ],
)
def test_segmentation(text, items):
    assert Segmenter(KNOWN).items(text) == items


def test_every_join_splits_back():
    rng = random.Random(1)
    split = Segmenter(KNOWN).items
    for size, sep in itertools.product((2, 3, 5), ("|", "; ", ", ", " / ", " + ", "~", "\t", "\n", " || ")):
        values = [rng.choice(KNOWN) for _ in range(size)]
        assert split(sep.join(values)) == values, (sep, values)


def test_very_long_text_is_split_whole():
    assert len(Segmenter(KNOWN).items("|".join(["AIR BAGS"] * 20000))) == 20000


def test_no_dictionary():
    assert Segmenter([]).items("a, b") == ["a", "b"]


def test_rows(spark):
    df = spark.createDataFrame([("1", "A|B"), ("1", "A|B"), ("2", None), ("3", ""), (None, "C;D"), ("4", "E")], "cmplid string, pos string")
    got = sorted(tuple(r) for r in packed_items(df, "cmplid", "pos", KNOWN, least=2).collect() if r["rec_key"])
    assert got == [("1", 1, "A"), ("1", 2, "B")]
