"""Attributes as known at event time, by dyadic decomposition of validity.

``validity_intervals`` turns versions (entity, valid_from, known_at, values) into disjoint half-open intervals [start, stop)
during which a version is the one to use: it is available (valid and known) and no better version, that is one with a later
valid_from or, at the same valid_from, a later known_at, is available yet. ``dyadic_lookup`` covers every interval by the
O(log T) dyadic nodes of its days; an event of day d lies under exactly one node per level, so the range join becomes an equi
join on (entity, level, node), and the exact half-open bounds decide within the boundary days. A hot entity spreads over its
time nodes instead of landing in one task, and events are reduced to distinct (entity, time) points before the join.

Defined results: a null in the entity's key, a null event time, or no version yet gives null attributes; versions with a null
valid_from or known_at never apply; repeated versions count once; versions equal in both times take the greatest values
(null lowest), so ties are settled without regard to row order; every event row comes out exactly once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import materialize

BROADCAST_ROWS = 500_000  # node rows (about 100 bytes each) up to which the node table is broadcast; beyond it is shuffled
MAX_LEVEL = 20  # 2**20 days
FOREVER_DAYS = 1 << 19
EPOCH = "1800-01-01"


def validity_intervals(versions: DataFrame, entity: list[str], valid_from: str, known_at: str, values: list[str]) -> DataFrame:
    """Rows (entity..., values..., start_ts, stop_ts); stop_ts null means open. Empty intervals are left out.

    The end of a version is the least availability time among better versions: a running minimum over versions from best to
    worst. It is taken in two levels, months first and then versions within a month, so that no task sorts all versions of a
    large entity.
    """
    usable = versions.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, valid_from, known_at]]))
    one = usable.groupBy(*entity, valid_from, known_at).agg(F.max(F.struct(*values)).alias("_v"))
    one = one.withColumns({"_at": F.greatest(valid_from, known_at), "_month": F.trunc(valid_from, "MM")})
    months = one.groupBy(*entity, "_month").agg(F.min("_at").alias("_least"))
    better_months = Window.partitionBy(*entity).orderBy(F.col("_month").desc()).rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_later", F.min("_least").over(better_months)).drop("_least")
    better = Window.partitionBy(*entity, "_month").orderBy(F.col(valid_from).desc(), F.col(known_at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ended = one.join(months, [*entity, "_month"]).withColumn("_stop", F.least(F.min("_at").over(better), F.col("_later")))
    return ended.filter(F.col("_stop").isNull() | (F.col("_stop") > F.col("_at"))).select(*entity, *[F.col(f"_v.{v}").alias(v) for v in values], F.col("_at").alias("start_ts"), F.col("_stop").alias("stop_ts"))


def day_number(ts: Column) -> Column:
    """Days since EPOCH, within the tree."""
    return F.greatest(F.least(F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date")), F.lit(FOREVER_DAYS * 2 - 2)), F.lit(0))


def dyadic_nodes(intervals: DataFrame) -> DataFrame:
    """One row per (interval, covering node): levels climb from both ends, taking a node wherever its parent would overhang."""
    first = day_number(F.col("start_ts"))
    last = F.when(F.col("stop_ts").isNull(), F.lit(FOREVER_DAYS * 2 - 1)).otherwise(day_number(F.col("stop_ts")) + 1)  # exclusive; the stop's own day is checked exactly
    levels = F.sequence(F.lit(0), F.lit(MAX_LEVEL))
    ceil_at = lambda x, k: F.floor((x + F.pow(F.lit(2.0), k) - 1) / F.pow(F.lit(2.0), k))
    floor_at = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k))

    def at_level(k: Column) -> Column:
        left, right = ceil_at(F.col("_a"), k), floor_at(F.col("_b"), k)
        return F.array_compact(
            F.array(
                F.when((left < right) & (left % 2 == 1), F.struct(k.cast("int").alias("lvl"), left.cast("int").alias("node"))),
                F.when((left < right) & (right % 2 == 1) & ~((left % 2 == 1) & (right - 1 == left)), F.struct(k.cast("int").alias("lvl"), (right - 1).cast("int").alias("node"))),
            )
        )

    # a node counts at its level only if the parent does not fit: odd left ends and odd right ends, as in an iterative segment tree
    return intervals.withColumns({"_a": first, "_b": last}).withColumn("_n", F.explode(F.flatten(F.transform(levels, at_level)))).select("*", "_n.lvl", "_n.node").drop("_a", "_b", "_n")


def dyadic_lookup(events: DataFrame, entity: list[str], event_time: str, intervals: DataFrame, values: list[str]) -> DataFrame:
    """Distinct (entity..., event_time) points of ``events`` with the attributes valid at them; points without any are absent."""
    nodes = materialize(dyadic_nodes(intervals), "dyadic-nodes")
    size = nodes.count()
    used = [r["lvl"] for r in nodes.select("lvl").distinct().collect()]  # at most MAX_LEVEL + 1 numbers
    if size <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    points = events.select(*entity, F.col(event_time).alias("_t")).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, "_t"]])).distinct()
    day = day_number(F.col("_t"))
    under = points.withColumn("lvl", F.explode(F.array(*[F.lit(k) for k in sorted(used)]) if used else F.array().cast("array<int>"))).withColumn("node", F.floor(day / F.pow(F.lit(2.0), F.col("lvl"))).cast("int"))
    hit = under.join(nodes, [*entity, "lvl", "node"]).filter((F.col("start_ts") <= F.col("_t")) & (F.col("stop_ts").isNull() | (F.col("_t") < F.col("stop_ts"))))
    return hit.select(*entity, F.col("_t").alias(event_time), *values)


def attributes_at_event_time(events: DataFrame, event_time: str, versions: DataFrame, entity: list[str], valid_from: str, known_at: str, values: dict[str, str]) -> DataFrame:
    """Every event row with ``values`` (version column -> output column) as valid and known at ``event_time``."""
    clean = versions.select(*entity, F.col(valid_from).alias("_from"), F.col(known_at).alias("_known"), *[F.col(v).alias(f"_val{i}") for i, v in enumerate(values)])
    names = [f"_val{i}" for i in range(len(values))]
    found = dyadic_lookup(events, entity, event_time, validity_intervals(clean, entity, "_from", "_known", names), names)
    keyed = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*entity, event_time])], *[F.col(n).alias(out) for n, out in zip(names, values.values())])
    on = reduce(lambda a, b: a & b, [events[c] == keyed[f"_k{i}"] for i, c in enumerate([*entity, event_time])])
    return events.join(keyed, on, "left").drop(*[f"_k{i}" for i in range(len(entity) + 1)])
