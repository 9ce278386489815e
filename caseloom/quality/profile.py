"""Column-level profile of a table by load, footers first.

Stage 1 reads footers and dictionary pages (``footers.read_chunks``). A column chunk whose row group holds one load, whose
null count is exact and whose dictionary is complete is *decided* when the dictionary alone fixes every count asked for: no
blank, zero or malformed candidate and no value histogram wanted, or a single candidate. Stage 2 scans, through Spark's own
reader, only the files and columns that still have an undecided chunk, and reduces them map-side to counts per distinct
value. Both stages emit the same count rows, so everything later is independent of where a count came from.

Defined results: null or blank (only U+0020) is *missing*; an absent column is all missing; repeated rows count each time; an
empty table gives an empty profile; a null load forms a load of its own that has no predecessor; extra columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.quality.footers import CHUNK_SCHEMA, read_chunks
from caseloom.session import materialize, ship_package

MISSING, ZERO, MALFORMED, VALID = "missing", "zero", "malformed", "valid"
HISTOGRAM_WIDTH = 1000


@dataclass(frozen=True)
class FieldRule:
    """A field's pattern (on the value without outer spaces) and whether its value histogram is wanted."""

    pattern: str
    histogram: bool = False


def value_kind(value: Column, pattern: str) -> Column:
    """missing / malformed / zero / valid of a raw value."""
    inner = F.trim(value)
    return (
        F.when(value.isNull() | (inner == ""), MISSING)
        .when(~inner.rlike(f"^(?:{pattern})$") | inner.contains("\n"), MALFORMED)
        .when(inner.try_cast("double") == 0, ZERO)
        .otherwise(VALID)
    )


def chunk_table(df: DataFrame, fields: list[str], load_field: str) -> DataFrame:
    """One row per column chunk of the table's parquet files (see ``footers``)."""
    spark = df.sparkSession
    ship_package(spark)
    files = df.inputFiles()
    paths = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return paths.mapInPandas(read_chunks(fields, load_field), CHUNK_SCHEMA)


def _not_valid(pattern: str):
    return lambda v: value_kind(v, pattern) != VALID


def decide_chunks(chunks: DataFrame, rules: Mapping[str, FieldRule]) -> DataFrame:
    """Adds ``decided``: whether the chunk's counts follow from its footer and dictionary alone."""
    suspicious = F.lit(False)
    wants = F.lit(False)
    for field, rule in rules.items():
        odd = F.exists("distinct_values", _not_valid(rule.pattern))
        suspicious = F.when(F.col("field") == field, odd).otherwise(suspicious)
        wants = F.when(F.col("field") == field, F.lit(rule.histogram)).otherwise(wants)
    known = F.col("load_value").isNotNull() & F.col("null_count").isNotNull() & F.col("all_dictionary")
    plain = ~suspicious & ~wants
    single = (F.size("distinct_values") <= 1) & (~suspicious | (F.size("distinct_values") == 0))
    return chunks.withColumn("decided", F.coalesce(known & (plain | single), F.lit(False)))


def _decided_counts(chunks: DataFrame, rules: Mapping[str, FieldRule]) -> DataFrame:
    """Count rows of decided chunks. Without a histogram the distinct candidates stand as rows of count 0 beside the total."""
    present = F.col("n_values") - F.col("null_count")
    base = chunks.filter("decided")
    nulls = base.filter("null_count > 0").select("load_value", "field", F.lit(MISSING).alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("key"), F.col("null_count").alias("n"))
    values = base.select("load_value", "field", F.posexplode("distinct_values").alias("i", "raw"), present.alias("present")).select(
        "load_value", "field", F.lit(VALID).alias("kind"), F.trim("raw").alias("value"), F.lit(None).cast("string").alias("key"), F.when(F.col("i") == 0, F.col("present")).otherwise(0).alias("n")
    )
    return nulls.unionByName(values)


def _scan_counts(df: DataFrame, fields: list[str], rules: Mapping[str, FieldRule], load_field: str, key_field: str) -> DataFrame:
    """Counts per (load, field, kind, value), with the record key where the value is malformed; combined map-side."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), value_kind(F.col(f), rules[f].pattern).alias("kind"), F.trim(F.col(f)).alias("value")) for f in fields])
    long = df.select(F.col(load_field).alias("load_value"), F.col(key_field).alias("key"), F.explode(entries).alias("e")).select(
        "load_value",
        "e.field",
        "e.kind",
        F.when(F.col("e.kind") != MISSING, F.col("e.value")).alias("value"),
        F.when(F.col("e.kind") == MALFORMED, F.col("key")).alias("key"),
    )
    return long.groupBy("load_value", "field", "kind", "value", "key").agg(F.count(F.lit(1)).alias("n"))


def value_counts_by_load(df: DataFrame, rules: Mapping[str, FieldRule], load_field: str, key_field: str) -> DataFrame:
    """Rows (load_value, field, kind, value, key, n), written once to the shared folder.

    ``df`` must be a plain parquet read; columns are decided from footers where possible and scanned elsewhere.
    """
    spark = df.sparkSession
    fields = list(rules)
    chunks = materialize(decide_chunks(chunk_table(df, fields, load_field), rules), "chunks")
    todo: dict[str, set[str]] = defaultdict(set)  # file -> columns with an undecided chunk: metadata, one entry per file
    for row in chunks.filter("NOT decided").select("file", "field").distinct().toLocalIterator():
        todo[row["file"]].add(row["field"])
    by_columns: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file, columns in todo.items():
        by_columns[tuple(sorted(columns))].append(file)
    # a chunk counts from its footer only if the whole file is decided for that column, for the scan takes whole files
    scanned = chunks.filter("NOT decided").select("file", "field").distinct()
    parts = [_decided_counts(chunks.join(F.broadcast(scanned) if len(todo) < 100_000 else scanned, ["file", "field"], "left_anti"), rules)]
    total = len(df.inputFiles())
    for columns, files in sorted(by_columns.items()):
        source = df if len(files) == total else spark.read.schema(df.schema).parquet(*files)
        parts.append(_scan_counts(source, list(columns), rules, load_field, key_field))
    return materialize(reduce(DataFrame.unionByName, parts), "value-counts")


def load_medians(counts: DataFrame, fields: list[str]) -> DataFrame:
    """Exact median of the valid values above zero per (load, field), by a two-level histogram.

    Level one ranks buckets of HISTOGRAM_WIDTH values; level two ranks values inside the one or two buckets that hold the
    middle ranks. No task ever holds more than one load's buckets or one bucket's values.
    """
    values = counts.filter((F.col("kind") == VALID) & F.col("field").isin(fields)).select("load_value", "field", F.col("value").try_cast("long").alias("v"), "n").withColumn("bucket", F.floor(F.col("v") / HISTOGRAM_WIDTH))
    values = values.groupBy("load_value", "field", "bucket", "v").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("load_value", "field")
    buckets = (
        values.groupBy("load_value", "field", "bucket")
        .agg(F.sum("n").alias("bn"))
        .withColumn("upto", F.sum("bn").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("bn").over(over))
    )
    ranks = F.array_distinct(F.array(F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)))
    wanted = buckets.withColumn("rank", F.explode(ranks)).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("bn")))
    wanted = wanted.select(F.col("load_value").alias("l"), F.col("field").alias("f"), F.col("bucket").alias("b"), (F.col("rank") - F.col("upto") + F.col("bn")).alias("rank"))
    inside = values.withColumn("cum", F.sum("n").over(Window.partitionBy("load_value", "field", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.join(wanted, F.col("load_value").eqNullSafe(F.col("l")) & (F.col("field") == F.col("f")) & (F.col("bucket") == F.col("b")))
    hit = hit.filter((F.col("rank") <= F.col("cum")) & (F.col("rank") > F.col("cum") - F.col("n")))
    # twice the median stays a whole number, so that ratios compare exactly
    return hit.groupBy("load_value", "field").agg((F.min("v") + F.max("v")).alias("median_x2"))


def load_shares(counts: DataFrame) -> DataFrame:
    """Rows, missing, zero and malformed counts per (load, field)."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return counts.groupBy("load_value", "field").agg(F.sum("n").alias("rows"), of(MISSING).alias("missing"), of(ZERO).alias("zeros"), of(MALFORMED).alias("malformed"))


def _with_previous(table: DataFrame, loads: DataFrame, columns: list[str]) -> DataFrame:
    """Adds each measure of the load before, among the loads that have rows."""
    w = Window.partitionBy("field").orderBy("load_seq")
    joined = table.join(F.broadcast(loads), "load_value")
    return joined.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def column_profile(counts: DataFrame, loads: DataFrame, rules: Mapping[str, FieldRule]) -> DataFrame:
    """One row per (load, field): rates, exact distinct values, range and median."""
    number = F.when(F.col("kind").isin(VALID, ZERO), F.col("value").try_cast("long"))
    shape = counts.groupBy("load_value", "field").agg(F.countDistinct("value").alias("distinct_values"), F.min(number).alias("min_value"), F.max(number).alias("max_value"))
    shares = load_shares(counts)
    medians = load_medians(counts, [f for f, r in rules.items() if r.histogram])
    rate = lambda c: F.round(F.col(c) / F.col("rows"), 6)
    return (
        shares.join(shape, ["load_value", "field"])
        .join(medians, ["load_value", "field"], "left")
        .join(F.broadcast(loads), "load_value", "left")
        .select(
            "load_value", "load_seq", "field", "rows",
            rate("missing").alias("null_rate"), rate("zeros").alias("zero_rate"), rate("malformed").alias("violation_rate"),
            "distinct_values", "min_value", "max_value", (F.col("median_x2") / 2).alias("median_value"),
        )
    )


def load_findings(counts: DataFrame, loads: DataFrame, median_fields: list[str], null_step: int = 10, zero_step: int = 10, violation_step: int = 5, ratio: tuple[int, int] = (3, 2)) -> DataFrame:
    """Violating records and loads that differ from the load before; steps are percentage points, compared exactly."""
    violations = counts.filter(F.col("kind") == MALFORMED).select(F.lit("violation").alias("case_kind"), F.col("field").alias("field_name"), F.col("load_value").alias("source_file"), F.col("key").alias("cmplid")).distinct()
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    shares = _with_previous(load_shares(counts), loads, ["rows", "missing", "zeros", "malformed"])
    parts = [violations]

    def finding(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("case_kind"), F.col("field").alias("field_name"), F.col("load_value").alias("source_file"), F.lit("").alias("cmplid"))

    for kind, column, step in (("null_share", "missing", null_step), ("zero_share", "zeros", zero_step), ("violation_share", "malformed", violation_step)):
        gap = F.abs(wide(column) * wide("prev_rows") - wide(f"prev_{column}") * wide("rows"))
        parts.append(finding(shares.filter(F.col("prev_rows").isNotNull() & (gap * 100 >= wide("rows") * wide("prev_rows") * step)), kind))
    up, down = ratio
    medians = _with_previous(load_medians(counts, median_fields), loads, ["median_x2"])
    now, before = F.col("median_x2"), F.col("prev_median_x2")
    parts.append(finding(medians.filter((now * down >= before * up) | (now * up <= before * down)), "median"))
    return reduce(DataFrame.unionByName, parts)
