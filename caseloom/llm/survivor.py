"""Best representative of each duplicate group, field by field.

Records that report the same complaint about the same components form a group. Its fields are unpivoted to long rows
(group, field, value); each row votes for its *normalised* value with source trust x recency decay, votes are summed per value
(map-side first), the winner of each field is taken by max_by, and the winners are pivoted back to one record. The trust in a
load is the share of its values that are there and fit their pattern. The record number voted for represents the group. Groups of one
record need no vote and pass through as they are.

Group keys are found from three narrow columns; only members of groups of two or more are unpivoted. All steps are hash
aggregations with map-side combination, so one group may hold any share of the rows.

Defined results: missing (null or blank) values do not vote, a field without a vote comes out null; a value that violates the
field's pattern counts a hundredth; equal sums go to the more recent value and then to the greater one; rows repeated whole vote
once; rows without complaint number or without components are groups of their own; a load unknown to the table of loads has
its own trust and the age of the oldest, a null one trust 1; extra columns are treated as any other field.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.packed import items_udf
from caseloom.session import materialize, ship_package, spread

HALF_LIFE_DAYS = 365.0
VIOLATION_WEIGHT = 0.01


def complaint_number(odino: Column) -> Column:
    """The digits of a complaint number however it is written: marks, spaces, leading zeros and a decimal tail do not count."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(odino), r"\.0*$", ""), "[^0-9]", "")
    return F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit(""))


def component_list(items: Column) -> Column:
    """A list of components in a comparable form, null where there is none."""
    folded = F.transform(items, lambda x: F.upper(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*:\s*", ":"), r"\s+", " "))))
    return F.when(F.size(items) > 0, F.array_join(folded, "\u001f"))


def with_group(df: DataFrame, number: str, components: str, known: list[str]) -> DataFrame:
    """Adds ``_group``: null for records that cannot be grouped."""
    ship_package(df.sparkSession)
    split = spread(df).withColumn("_items", items_udf(known)(F.col(components)))
    return split.withColumns({"_num": complaint_number(F.col(number)), "_parts": component_list(F.col("_items"))}).drop("_items").withColumn("_group", F.concat_ws("\u001e", "_num", "_parts")).withColumn("_group", F.when(F.col("_num").isNotNull() & F.col("_parts").isNotNull(), F.col("_group"))).drop("_num", "_parts")


def normalised(field: str, value: Column, patterns: Mapping[str, str], numbers: tuple[str, ...]) -> Column:
    """Value as compared in the vote: complaint numbers by digits, numeric fields by number, others without case and spacing."""
    plain = F.upper(F.trim(F.regexp_replace(value, r"\s+", " ")))
    if field in numbers:
        return F.coalesce(F.regexp_replace(F.regexp_replace(plain, "[, ]", "").try_cast("decimal(18,3)").cast("string"), r"\.?0+$", ""), plain)
    if field == "odino":
        return F.coalesce(complaint_number(value), plain)
    return plain


def load_trust(df: DataFrame, source: str, patterns: Mapping[str, str]) -> DataFrame:
    """(source, trust): the share of a load's values in the fields with a pattern that are there and fit it, over all rows.

    One row per load; a load without rows has no trust of its own and counts as 1, as does a null source.
    """
    fits = [F.coalesce(F.trim(F.col(f).cast("string")).rlike(f"^(?:{p})$"), F.lit(False)).cast("int") for f, p in patterns.items()]
    return df.groupBy(F.col(source).alias("_src")).agg(F.round(F.sum(sum(fits[1:], fits[0])) / (F.count(F.lit(1)) * len(fits)), 6).alias("trust"))


def load_weights(sources: DataFrame, trust: DataFrame) -> DataFrame:
    """(_src, _w, _at): trust times the decay of age, a row per load; ``sources`` has (source_file, delivered_at)."""
    span = sources.groupBy(F.col("source_file").alias("_src")).agg(F.max("delivered_at").alias("_at"))
    ends = span.agg(F.max("_at").alias("_newest"), F.min("_at").alias("_oldest"))
    table = trust.join(span, "_src", "full").crossJoin(F.broadcast(ends))  # one row beside a row per load
    age = F.coalesce(F.datediff("_newest", "_at"), F.datediff("_newest", "_oldest"), F.lit(0))
    return table.select("_src", (F.pow(F.lit(0.5), age / F.lit(HALF_LIFE_DAYS)) * F.coalesce("trust", F.lit(1.0))).alias("_w"), "_at", F.pow(F.lit(0.5), F.coalesce(F.datediff("_newest", "_oldest"), F.lit(0)) / F.lit(HALF_LIFE_DAYS)).alias("_w_oldest"))


def field_votes(members: DataFrame, fields: list[str], source: str, weights: DataFrame, patterns: Mapping[str, str], numbers: tuple[str, ...] = ("miles", "veh_speed")) -> DataFrame:
    """Votes (_group, field, norm, raw, votes, latest) by the weights of the rows' loads (``load_weights``)."""
    oldest = weights.agg(F.min("_w_oldest").alias("_least"))
    rows = members.select("_group", *fields, *([source] if source not in fields else [])).distinct()  # rows repeated whole vote once
    joined = rows.join(weights, rows[source] == weights["_src"], "left").crossJoin(F.broadcast(oldest))  # one row
    weight = F.coalesce("_w", "_least", F.lit(1.0))

    def entry(f: str) -> Column:
        fits = F.when(F.trim(F.col(f)).rlike(f"^(?:{patterns[f]})$"), 1.0).otherwise(VIOLATION_WEIGHT) if f in patterns else F.lit(1.0)
        return F.struct(F.lit(f).alias("field"), normalised(f, F.col(f).cast("string"), patterns, numbers).alias("norm"), F.trim(F.col(f).cast("string")).alias("raw"), fits.alias("fits"))

    long = joined.select("_group", weight.alias("_w"), F.col("_at"), F.explode(F.array(*[entry(f) for f in fields])).alias("e"))
    long = long.select("_group", "e.field", "e.norm", "e.raw", (F.col("_w") * F.col("e.fits")).alias("_w"), "_at").filter(F.col("norm").isNotNull() & (F.col("norm") != ""))
    return long.groupBy("_group", "field", "norm", "raw").agg(F.sum("_w").alias("votes"), F.max("_at").alias("latest"))


def winners(votes: DataFrame) -> DataFrame:
    """(_group, field, value, votes): sums per normalised value, then max_by; the most voted writing stands for the value."""
    per_value = votes.groupBy("_group", "field", "norm").agg(F.round(F.sum("votes"), 9).alias("votes"), F.max("latest").alias("latest"), F.max_by("raw", F.struct(F.round("votes", 9), "latest", "raw")).alias("raw"))
    best = F.struct("votes", "latest", "norm")
    return per_value.groupBy("_group", "field").agg(F.max_by("raw", best).alias("value"), F.max("votes").alias("votes"))


def pivot_back(won: DataFrame, fields: list[str]) -> DataFrame:
    """One row per group with a column per field."""
    return won.groupBy("_group").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def duplicate_members(df: DataFrame, record: str, number: str, components: str, known: list[str]) -> DataFrame:
    """The groups of two or more different records: (_group, n_records), from the narrow columns only."""
    keyed = with_group(df.select(record, number, components), number, components, known).filter(F.col("_group").isNotNull())
    ends = keyed.groupBy("_group").agg(F.min(record).alias("a"), F.max(record).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return ends.filter(~F.col("a").eqNullSafe(F.col("b"))).select("_group", "n_rows")


def survivors(df: DataFrame, record: str, number: str, components: str, known: list[str], source: str, weights: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """One record per group of duplicates: ``n_rows`` and every field of ``df`` with its winning value."""
    fields = df.columns
    groups = materialize(duplicate_members(df, record, number, components, known), "dup-groups")
    members = with_group(df, number, components, known).join(groups.select("_group"), "_group", "left_semi")
    won = winners(field_votes(members, fields, source, weights, patterns))
    return pivot_back(won, fields).join(groups, "_group").drop("_group")


def memberships(df: DataFrame, record: str, number: str, components: str, known: list[str], source: str, weights: DataFrame) -> DataFrame:
    """(record, representative, n_records) of every record in a group of two or more: the representative is the record number
    that the group's rows vote for, by trust and recency."""
    keyed = with_group(df.select(record, number, components, source), number, components, known).filter(F.col("_group").isNotNull() & F.col(record).isNotNull())
    votes = materialize(field_votes(keyed, [record], source, weights, {}), "id-votes")
    several = votes.groupBy("_group").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("_group")
    votes = materialize(votes.join(several, "_group", "left_semi"), "dup-votes")  # most groups are of one record
    won = winners(votes).select("_group", F.col("value").alias("representative"))
    sizes = votes.groupBy("_group").agg(F.countDistinct("raw").alias("n_records"))
    return votes.select("_group", F.col("raw").alias(record)).distinct().join(won.join(sizes, "_group"), "_group").select(record, "representative", "n_records", "_group")


def duplicate_pairs(df: DataFrame, record: str, number: str, components: str, known: list[str], source: str, weights: DataFrame) -> DataFrame:
    """Pairs of different records of a group, the lesser first: each member with its representative, and the other members with
    one another where there are more than two records."""
    member = materialize(memberships(df, record, number, components, known, source, weights), "dup-memberships")
    star = member.filter(F.col(record) != F.col("representative")).select(F.least(record, "representative").alias("cmplid_a"), F.greatest(record, "representative").alias("cmplid_b"))
    rest = member.filter((F.col("n_records") > 2) & (F.col(record) != F.col("representative"))).select("_group", F.col(record).alias("id"))
    left, right = rest.withColumnRenamed("id", "cmplid_a"), rest.withColumnRenamed("id", "cmplid_b")
    return star.unionByName(left.join(right, "_group").filter("cmplid_a < cmplid_b").select("cmplid_a", "cmplid_b"))
