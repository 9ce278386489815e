"""Term frequencies against direct counting, with small sort buffers."""

from __future__ import annotations

import collections
import random
import re

import pytest

from caseloom.llm import terms


def brute(texts):
    occ, rec = collections.Counter(), collections.Counter()
    for t in texts:
        words = [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) > 1]
        occ.update(words)
        rec.update(set(words))
    return {w: (occ[w], rec[w]) for w in occ}


@pytest.mark.parametrize("buffer", [3, 50, 2_000_000])
def test_counts(spark, monkeypatch, buffer):
    monkeypatch.setattr(terms, "BUFFER_PAIRS", buffer)
    rng = random.Random(buffer)
    texts = [" ".join(rng.choice(["the", "The", "brake", "a", "Straße", "日本語", "x9", "zz"]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    texts += [None, "", "  ", texts[0], texts[0], "word " * 5000, "a_b-c'd éé"]
    df = spark.createDataFrame([(t, 1) for t in texts], "cdescr string, term int").repartition(3)
    got, total = terms.term_frequencies(df, "cdescr")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got.collect()} == brute(texts)
    assert total == len(texts) - 1


def test_run_scan_without_spark():
    import numpy as np

    codes, occ, rec = terms.sorted_run(np.array([1, 0, 1, 1]), np.array([5, 5, 5, 6]), 2)
    assert (list(codes), list(occ), list(rec)) == ([0, 1], [1, 3], [1, 2])


def test_marks(spark):
    df = spark.createDataFrame([("a", 9, 3), ("b", 9, 2), ("c", 9, 2001), ("d", 9, 2000)], "term string, occurrences long, records long")
    assert {r["term"]: r["verdict"] for r in terms.mark_terms(df, 10000).collect()} == {"a": "usual", "b": "rare", "c": "common", "d": "usual"}


def test_empty(spark):
    got, total = terms.term_frequencies(spark.createDataFrame([], "cdescr string"), "cdescr")
    assert got.count() == 0 and total == 0
