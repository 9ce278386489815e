"""As-known lookups against brute force."""

from __future__ import annotations

import datetime as dt
import random

from caseloom.operators.asof import attributes_at_event_time


def day(n, seconds=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, seconds=seconds)


def right(versions, key, t):
    best = None
    for k, f, known, v in versions:
        if None in (k, f, known) or key is None or t is None or k != key or f > t or known > t:
            continue
        rank = (f, known, v is not None, v or 0)
        if best is None or rank > best[0]:
            best = (rank, v)
    return best and best[1]


def test_against_brute_force(spark):
    rng = random.Random(4)
    versions = []
    for _ in range(300):
        f = rng.randrange(0, 400)
        row = (rng.choice(["a", "b", "hot", "hot", None]), day(f) if rng.random() > 0.03 else None, day(f + rng.choice([-3, 0, 1, 60]), rng.randrange(86400)), rng.choice([None, *range(9)]))
        versions += [row] * rng.choice([1, 1, 2])
    events = [(i, rng.choice(["a", "hot", "zz", None]), day(rng.randrange(-5, 480), rng.choice([0, 43200])) if rng.random() > 0.05 else None) for i in range(400)]
    events.append(events[0])
    df = spark.createDataFrame(events, "i int, k string, t timestamp")
    table = spark.createDataFrame(versions, "k string, f timestamp, known timestamp, v int")
    got = attributes_at_event_time(df, "t", table, ["k"], "f", "known", {"v": "val"}).collect()
    assert len(got) == len(events)
    assert all(r["val"] == right(versions, r["k"], r["t"]) for r in got)


def test_no_versions_and_no_events(spark):
    df = spark.createDataFrame([(1, "a", day(3))], "i int, k string, t timestamp")
    none = spark.createDataFrame([], "k string, f timestamp, known timestamp, v int")
    assert attributes_at_event_time(df, "t", none, ["k"], "f", "known", {"v": "val"}).first()["val"] is None
    assert attributes_at_event_time(df.limit(0), "t", none, ["k"], "f", "known", {"v": "val"}).count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", day(3), 7)], "k string, t timestamp, v int")
    table = spark.createDataFrame([("a", day(1), day(1), 5)], "k string, f timestamp, known timestamp, v int")
    row = attributes_at_event_time(df, "t", table, ["k"], "f", "known", {"v": "val"}).first()
    assert (row["v"], row["val"]) == (7, 5)
