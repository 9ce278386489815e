"""Collapse of rows into one case per complaint number, and the diagnostics around it.

Every collapse is one ``groupBy`` with map-side partial aggregates. Picking a first value orders by a full key, so results never
depend on row order: the first non-null value of each column by (record number, all of the value), nulls last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import columns as C
from caseloom.operators.cleaning import add_lag, add_severity

FIRST_COLUMNS = "mfr_name maketxt modeltxt yeartxt state ldate faildate datea cmpl_type drive_train fuel_sys fuel_type trans_type num_cyls source_era source_zip source_file".split()
MAX_COLUMNS = "miles veh_speed injured deaths".split()
YN_COLUMNS = "crash fire police_rpt_yn orig_owner_yn anti_brakes_yn cruise_cont_yn orig_equip_yn repaired_yn medical_attn vehicles_towed_yn".split()
FIT_END, FIT_ROWS = "2025-12-31", 250


def first_non_null(c: str, order: str = "cmplid") -> Column:
    """The column's first non-null value by (order, value)."""
    return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("k"), F.col(c).alias("v"))))["v"]


def any_true(c: Column) -> Column:
    """Whether any value is true; null counts as false."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def yes_no(c: str) -> Column:
    """Y if any Y, else N if anything is stated, else null."""
    return F.when(any_true(F.col(c) == "Y"), "Y").when(F.count(c) > 0, "N")


def sorted_distinct_text(c: Column, sep: str = "|") -> Column:
    """Distinct non-blank texts, sorted and joined; '' if none."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit("")))), sep)


def collapse_cases(rows: DataFrame, mode: str, key: str = "odino", order: str = "cmplid") -> DataFrame:
    """One row per case. ``mode``: base, single (one component group) or multi (sorted list of groups)."""
    if mode not in ("base", "single", "multi"):
        raise ValueError(f"unknown mode: {mode}")
    has = set(rows.columns)
    aggregates = [F.count(F.lit(1)).alias("component_row_count")]
    if mode == "single":
        aggregates.append(first_non_null("component_group", order).alias("component_group"))
    if mode == "multi":
        aggregates += [sorted_distinct_text(F.col("component_group")).alias("component_groups"), F.countDistinct("component_group").alias("component_group_count")]
    aggregates += [first_non_null(c, order).alias(c) for c in FIRST_COLUMNS if c in has]
    aggregates += [F.max(c).alias(c) for c in MAX_COLUMNS if c in has]
    aggregates += [any_true(F.col(c)).alias(c) for c in rows.columns if c.startswith("flag_") or c.endswith("_zero_flag")]
    aggregates += [yes_no(c).alias(c) for c in YN_COLUMNS if c in has]
    cases = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)
    cases = cases.withColumns({"miles_missing_flag": F.col("miles").isNull(), "veh_speed_missing_flag": F.col("veh_speed").isNull()})
    return add_severity(add_lag(cases))


def severity_cases(clean: DataFrame) -> DataFrame:
    """Vehicle cases with row and component counts and the widest narrative-independent columns."""
    rows = clean.filter(F.col("prod_type") == "V").withColumn("_label", C.component_label(F.col("compdesc")))
    counts = rows.filter(F.col("odino").isNotNull()).groupBy("odino").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("_label").alias("component_count"))
    return collapse_cases(rows.drop("_label"), "base").drop("component_row_count").join(counts, "odino")


def case_tables(components: DataFrame) -> dict[str, DataFrame]:
    """base, single, single benchmark and multi case tables from component rows.

    Cases with one distinct group are single; groups with FIT_ROWS single cases or more up to FIT_END are kept for the benchmark.
    """
    kept = components.filter("component_keep_flag")
    one = kept.groupBy("odino").agg(F.countDistinct("component_group").alias("_groups"))
    single_ids = one.filter("_groups = 1").select("odino")
    base = collapse_cases(components.join(kept.select("odino").distinct(), "odino", "left_semi"), "base")
    single = collapse_cases(kept.join(single_ids, "odino", "left_semi"), "single")
    fit = single.filter(F.col("ldate") <= F.lit(FIT_END).cast("date")).groupBy("component_group").agg(F.count(F.lit(1)).alias("fit_rows"))
    single = single.join(F.broadcast(fit), "component_group", "left").withColumn("benchmark_keep_flag", F.coalesce(F.col("fit_rows") >= FIT_ROWS, F.lit(False)))
    return {"base": base, "single": single, "single_benchmark": single.filter("benchmark_keep_flag"), "multi": collapse_cases(kept, "multi")}


def best_text(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """The best narrative of each case: longest, then earliest, then lowest record number; else the earliest row's values.

    Columns are picked one by one, each the first non-null in that order.
    """
    base = rows.join(universe.select("odino").distinct(), "odino", "left_semi") if universe is not None else rows
    base = base.filter(F.col("odino").isNotNull()).withColumn("norm", F.coalesce(C.squeeze(F.col("cdescr")), F.lit("")))
    number = F.col("cmplid").try_cast("long")
    early = F.struct(F.col("ldate").isNull().alias("a"), F.col("ldate").alias("b"), number.isNull().alias("c"), number.alias("d"), F.col("cmplid").alias("e"))
    longest = F.struct((-F.length("norm")).alias("z"), early.alias("e"))

    def pick(c: str) -> Column:
        full = F.min_by(F.col(c), F.when((F.col("norm") != "") & F.col(c).isNotNull(), longest))
        return F.coalesce(full, F.min_by(F.col(c), F.when(F.col(c).isNotNull(), early)))

    chosen = base.groupBy("odino").agg(*[pick(c).alias(c) for c in ("cdescr", "norm", "source_era", "ldate")])
    placeholder = C.is_placeholder(F.col("norm"))
    text = F.when(placeholder, "").otherwise(F.col("norm"))
    return chosen.select(
        "odino", "cdescr", text.alias("cdescr_model_text"), (F.col("norm") == "").alias("cdescr_missing_flag"), placeholder.alias("cdescr_placeholder_flag"),
        F.length(text).alias("cdescr_char_len"), C.word_count(text).alias("cdescr_word_count"), "source_era", "ldate",
    )


def merge_text(cases: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Cases with their text, defaults where there is none (missing true, placeholder false, empty text, zero lengths)."""
    side = sidecar.select("odino", "cdescr_model_text", "cdescr_missing_flag", "cdescr_placeholder_flag", "cdescr_char_len", "cdescr_word_count", F.col("source_era").alias("_era"))
    out = cases.join(side, "odino", "left").withColumns(
        {
            "cdescr_model_text": F.coalesce("cdescr_model_text", F.lit("")),
            "cdescr_missing_flag": F.coalesce("cdescr_missing_flag", F.lit(True)),
            "cdescr_placeholder_flag": F.coalesce("cdescr_placeholder_flag", F.lit(False)),
            "cdescr_char_len": F.coalesce("cdescr_char_len", F.lit(0)),
            "cdescr_word_count": F.coalesce("cdescr_word_count", F.lit(0)),
        }
    )
    era = F.coalesce("source_era", "_era") if "source_era" in cases.columns else F.col("_era")
    return out.withColumn("source_era", era).drop("_era")


def conflict_summary(rows: DataFrame, columns: list[str], key: str = "odino") -> DataFrame:
    """Per column: cases with more than one distinct non-null value, and their share of all cases."""
    per_case = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    totals = per_case.agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("conflict_cases")) for c in columns]))
    return totals.select("cases", pairs.alias("p")).select("p.column_name", "cases", "p.conflict_cases", F.round(F.col("p.conflict_cases") / F.greatest("cases", F.lit(1)), 6).alias("conflict_rate"))


def text_conflicts(rows: DataFrame) -> DataFrame:
    """Cases whose rows carry more than one distinct narrative."""
    norm = F.nullif(C.squeeze(F.col("cdescr")), F.lit(""))
    found = rows.filter(F.col("odino").isNotNull()).groupBy("odino").agg(F.count(F.lit(1)).alias("text_rows"), F.countDistinct(F.md5(norm)).alias("distinct_texts"), F.min("ldate").alias("first_date"), F.max("ldate").alias("last_date"))
    return found.filter("distinct_texts > 1")


def text_overlap(sidecar: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each (name, later name, cut, end): distinct texts before the cut, in [cut, end), and in both. Texts travel as hashes."""
    texts = sidecar.filter(F.col("cdescr_model_text") != "").select(F.sha2("cdescr_model_text", 256).alias("h"), "ldate").filter(F.col("ldate").isNotNull())
    marks = texts.groupBy("h").agg(
        *[x for i, (_, _, cut, end) in enumerate(pairs) for x in (F.bool_or(F.col("ldate") < F.lit(cut).cast("date")).alias(f"p{i}"), F.bool_or((F.col("ldate") >= F.lit(cut).cast("date")) & (F.col("ldate") < F.lit(end).cast("date"))).alias(f"l{i}"))]
    )
    totals = marks.agg(*[x for i in range(len(pairs)) for x in (F.count_if(F.col(f"p{i}")).alias(f"a{i}"), F.count_if(F.col(f"l{i}")).alias(f"b{i}"), F.count_if(F.col(f"p{i}") & F.col(f"l{i}")).alias(f"c{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prior_split"), F.lit(n).alias("later_split"), F.col(f"a{i}").alias("prior_texts"), F.col(f"b{i}").alias("later_texts"), F.col(f"c{i}").alias("overlap_texts")) for i, (p, n, _, _) in enumerate(pairs)]))
    return totals.select(rows.alias("r")).select("r.*", F.round(F.col("r.overlap_texts") / F.greatest("r.later_texts", F.lit(1)), 6).alias("overlap_share"))


def overlap_flag(later: DataFrame, prior: DataFrame, text: str) -> DataFrame:
    """Later rows with ``seen_before``: whether the same text occurs among prior rows."""
    known = prior.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("_h")).distinct().withColumn("_seen", F.lit(True))
    return later.withColumn("_h", F.sha2(text, 256)).join(known, "_h", "left").withColumn("seen_before", F.coalesce("_seen", F.lit(False))).drop("_h", "_seen")


def era_drift(clean: DataFrame) -> DataFrame:
    """GROUPING SETS ((), (source_era)) in long form: per field counts, null, zero and yes rates, mean and median."""
    numeric = [c for c in ("miles", "veh_speed", "injured", "deaths", "yeartxt") if c in clean.columns]
    marks = [c for c in ("crash", "fire", "medical_attn", "vehicles_towed_yn") if c in clean.columns]
    zero = {c: F.count_if(F.col(f"{c}_zero_flag")) if f"{c}_zero_flag" in clean.columns else F.count_if(F.col(c) == 0) for c in numeric}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in numeric:
        aggregates += [F.count(c).alias(f"{c}_p"), zero[c].alias(f"{c}_z"), F.avg(c).alias(f"{c}_m"), F.percentile(c, 0.5).alias(f"{c}_h")]
    for c in marks:
        aggregates += [F.count(c).alias(f"{c}_p"), F.count_if(F.col(c) == "N").alias(f"{c}_z"), F.avg((F.col(c) == "Y").cast("int")).alias(f"{c}_m")]
    wide = clean.groupingSets([["source_era"], []], "source_era").agg(F.grouping("source_era").alias("g"), *aggregates)
    none = F.lit(None).cast("double")
    entry = lambda c, kind: F.struct(F.lit(c).alias("field_name"), F.lit(kind).alias("field_kind"), F.col(f"{c}_p").alias("present_count"), F.col(f"{c}_z").alias("zero_or_no_count"), F.round(f"{c}_m", 6).alias("mean_value"), (F.round(f"{c}_h", 6) if kind == "number" else none).alias("median_value"))
    long = wide.select(F.when(F.col("g") == 1, "overall").otherwise(F.coalesce("source_era", F.lit("unknown"))).alias("era"), "n", F.explode(F.array(*[entry(c, "number") for c in numeric], *[entry(c, "yes_no") for c in marks])).alias("e"))
    return long.select("era", F.col("n").alias("row_count"), "e.*", F.round(1 - F.col("e.present_count") / F.col("n"), 6).alias("null_rate"))


def scope_summary(cases: DataFrame) -> DataFrame:
    """Overall and by year: cases, single-group and multi-group cases, severity rates."""
    rows = cases.withColumn("yr", F.year("ldate"))
    wide = rows.groupingSets([["yr"], []], "yr").agg(
        F.grouping("yr").alias("g"), F.count(F.lit(1)).alias("cases"), F.count_if(F.col("component_group_count") == 1).alias("single_cases"), F.count_if(F.col("component_group_count") > 1).alias("multi_cases"),
        F.round(F.avg(F.col("severity_primary_flag").cast("int")), 6).alias("primary_rate"), F.round(F.avg(F.col("severity_broad_flag").cast("int")), 6).alias("broad_rate"),
    )
    return wide.select(F.when(F.col("g") == 1, "overall").otherwise(F.coalesce(F.col("yr").cast("string"), F.lit("unknown"))).alias("scope"), "cases", "single_cases", "multi_cases", F.round(F.col("single_cases") / F.col("cases"), 6).alias("single_share"), "primary_rate", "broad_rate")


def group_presence(kept: DataFrame) -> DataFrame:
    """Per component group: distinct cases overall, in single-group and in multi-group cases, with shares."""
    pairs = kept.filter("odino IS NOT NULL AND component_group IS NOT NULL").select("odino", "component_group").distinct()
    sizes = pairs.groupBy("odino").agg(F.count(F.lit(1)).alias("k"))
    counted = pairs.join(sizes, "odino").groupBy("component_group").agg(F.count(F.lit(1)).alias("all_cases"), F.count_if(F.col("k") == 1).alias("single_cases"), F.count_if(F.col("k") > 1).alias("multi_cases"))
    total = sizes.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("component_group", "all_cases", "single_cases", "multi_cases", F.round(F.col("all_cases") / F.col("total"), 6).alias("case_share"))  # one-row side


def cleaning_summary(clean: DataFrame) -> DataFrame:
    """Named scalar metrics of a cleaning run, in one pass."""
    flags = [c for c in clean.columns if c.startswith("flag_") or c.endswith("_flag")]
    wide = clean.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("odino").alias("cases"), *[F.count_if(F.col(c)).alias(c) for c in flags])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in ["rows", "cases", *flags]])).alias("m")).select("m.*")
