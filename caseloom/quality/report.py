"""Data-quality report of a table in one aggregation pass: dates, numbers, lengths, codes, keys, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.columns import blank_to_null

ZERO_DATES = ("0", "00000000", "0000-00-00")
EXAMPLES = 5


def date_checks(c: str) -> list[Column]:
    v = blank_to_null(F.col(c))
    zero = v.isin(*ZERO_DATES)
    bad = ~zero & (~v.rlike(r"^\d{8}$") | F.try_to_date(v, "yyyyMMdd").isNull())
    return [F.count(v).alias(f"{c}__present"), F.count_if(zero).alias(f"{c}__zero"), F.count_if(bad).alias(f"{c}__invalid")]


def date_examples(df: DataFrame, c: str) -> DataFrame:
    """The least EXAMPLES distinct invalid values of a date column."""
    v = blank_to_null(F.col(c))
    bad = ~v.isin(*ZERO_DATES) & (~v.rlike(r"^\d{8}$") | F.try_to_date(v, "yyyyMMdd").isNull())
    return df.filter(bad).select(v.alias("example")).distinct().orderBy("example").limit(EXAMPLES)


def number_checks(c: str, digits: int | None = None) -> list[Column]:
    v = blank_to_null(F.col(c))
    x = v.try_cast("double")
    over = F.length(F.regexp_replace(v, "[^0-9]", "")) > digits if digits else F.lit(False)
    return [F.count(v).alias(f"{c}__present"), F.count_if(v.isNotNull() & x.isNull()).alias(f"{c}__non_numeric"), F.count_if(F.abs(x % 1) >= 1e-9).alias(f"{c}__non_integer"), F.count_if(over).alias(f"{c}__overflow")]


def length_checks(c: str, most: int) -> list[Column]:
    return [F.max(F.length(c)).alias(f"{c}__max_length"), F.count_if(F.length(c) > most).alias(f"{c}__too_long")]


def code_checks(c: str, allowed: list[str]) -> list[Column]:
    v = F.upper(blank_to_null(F.col(c)))
    return [F.count_if(~v.isin(*allowed)).alias(f"{c}__unexpected")]


def key_checks(c: str) -> list[Column]:
    return [F.count_if(blank_to_null(F.col(c)).isNull()).alias(f"{c}__null"), (F.count(c) - F.countDistinct(c)).alias(f"{c}__repeats")]


def quality_report(df: DataFrame, dates: list[str] = (), numbers: dict[str, int | None] | None = None, lengths: dict[str, int] | None = None, codes: dict[str, list[str]] | None = None, keys: list[str] = ()) -> DataFrame:
    """Long rows (field_name, check_name, value). Date examples are left to ``date_examples``; every check counts over all rows."""
    checks: list[Column] = [F.count(F.lit(1)).alias("table__rows")]
    for c in dates:
        checks += date_checks(c)
    for c, digits in (numbers or {}).items():
        checks += number_checks(c, digits)
    for c, most in (lengths or {}).items():
        checks += length_checks(c, most)
    for c, allowed in (codes or {}).items():
        checks += code_checks(c, allowed)
    for c in keys:
        checks += key_checks(c)
    wide = df.agg(*checks)
    entries = F.array(*[F.struct(F.lit(n.split("__")[0]).alias("field_name"), F.lit(n.split("__")[1]).alias("check_name"), F.col(n).cast("long").alias("value")) for n in wide.columns])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows repeated whole: count of surplus copies, by two hashes of all columns and of which are null (a hash alone skips nulls)."""
    parts = [*df.columns, *[F.col(f"`{c}`").isNull() for c in df.columns]]
    hashed = df.select(F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return hashed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def column_audit(df: DataFrame) -> DataFrame:
    """Per column: nulls, share, distinct values, share that reads as a number. Values over 32 characters travel as their digest."""

    def cell(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column_name"), F.when(F.length(v) > 32, F.concat(F.lit("#"), F.md5(v))).otherwise(v).alias("v"), v.try_cast("double").isNotNull().alias("numeric"))

    per_value = df.select(F.explode(F.array(*[cell(c) for c in df.columns])).alias("c")).select("c.*").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"), F.max("numeric").alias("numeric"))
    out = per_value.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("numeric"), F.col("n"))), F.lit(0)).alias("numeric"))
    return out.select("column_name", "n_rows", "nulls", F.round(F.col("nulls") / F.col("n_rows"), 6).alias("null_share"), "distinct_values", F.round(F.col("numeric") / F.greatest(F.col("n_rows") - F.col("nulls"), F.lit(1)), 6).alias("numeric_share"))


def outlier_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: quartiles, p99, upper fence and values above it."""
    stats = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.99))).alias(c) for c in columns])
    limits = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("q")) for c in columns])).alias("s")).select("s.*")
    limits = limits.select("column_name", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), F.col("q")[2].alias("p99"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("upper_fence"))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*")
    over = cells.join(F.broadcast(limits), "column_name").groupBy("column_name").agg(F.count_if(F.col("x") > F.col("upper_fence")).alias("above_fence"))
    return limits.join(over, "column_name")


def null_rates_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Null share of each column per group, long."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns])
    return wide.select(by, "n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in columns])).alias("e")).select(by, "n_rows", "e.*")


def finite(df: DataFrame, columns: list[str]) -> None:
    """Raises if any column holds NaN or infinity."""
    bad = df.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in columns]).first()
    names = [c for c in columns if bad[c]]
    if names:
        raise ValueError(f"not finite: {', '.join(names)}")


def require_dates(df: DataFrame, columns: list[str]) -> None:
    """Raises if a column that must hold dates has nulls (dates that could not be read among them)."""
    bad = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    names = [f"{c} ({bad[c]})" for c in columns if bad[c]]
    if names:
        raise ValueError(f"rows without a date: {', '.join(names)}")


def report_text(report: DataFrame, most: int = 8) -> str:
    """The quality report as text: a line per field with its checks in order; a list is clipped after ``most`` entries."""
    fields: dict[str, list[str]] = {}
    for r in report.orderBy("field_name", "check_name").collect():  # a row per field and check
        fields.setdefault(r["field_name"], []).append(f"{r['check_name']} {r['value']}")
    lines = []
    for name, checks in fields.items():
        more = f", and {len(checks) - most} more" if len(checks) > most else ""
        lines.append(f"{name}: {', '.join(checks[:most])}{more}")
    return "\n".join(lines)
