"""Queries p2, p3, p5 and p7: the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.asof import attributes_at_event_time
from caseloom.operators.packed import known_values, packed_items
from caseloom.quality import drift, profile
from caseloom.session import load_table

COMPLAINT_RULES = {
    "miles": profile.FieldRule("[0-9]{1,7}", histogram=True),
    "veh_speed": profile.FieldRule("[0-9]{1,3}", histogram=True),
    "yeartxt": profile.FieldRule("[0-9]{4}"),
    "deaths": profile.FieldRule("[0-9]{1,2}"),
}


def _loads(spark: SparkSession, sf: str, table: str, name: str) -> DataFrame:
    return load_table(spark, sf, "source_files").filter(F.col("table_name") == table).select(F.col("source_file").alias(name), "load_seq").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = profile.value_counts_by_load(load_table(spark, sf, "complaints"), COMPLAINT_RULES, "source_file", "cmplid")
    return profile.load_findings(counts, _loads(spark, sf, "complaints", "load_value"), ["miles", "veh_speed"])


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    counts = profile.value_counts_by_load(load_table(spark, sf, "complaints"), COMPLAINT_RULES, "source_file", "cmplid")
    return profile.column_profile(counts, _loads(spark, sf, "complaints", "load_value"), COMPLAINT_RULES).withColumnsRenamed({"load_value": "source_file", "field": "field_name", "rows": "n_rows"})


def p2_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Per field: column chunks, those decided from footers and dictionaries, exact nulls and distinct candidates."""
    chunks = profile.decide_chunks(profile.chunk_table(load_table(spark, sf, "complaints"), list(COMPLAINT_RULES), "source_file"), COMPLAINT_RULES)
    return chunks.groupBy(F.col("field").alias("field_name")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("decided")).alias("decided_chunks"),
        F.sum("null_count").alias("footer_nulls"),
        F.min("min_value").alias("footer_min"),
        F.max("max_value").alias("footer_max"),
    )


def _drift(spark: SparkSession, sf: str):
    return drift.feed_drift(load_table(spark, sf, "complaint_feed"), _loads(spark, sf, "complaint_feed", "file"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    _, _, report = _drift(spark, sf)
    return spark.createDataFrame(report, drift.REPORT_SCHEMA).select("source_file", "change_kind", "field_name", "old_name")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    _, _, report = _drift(spark, sf)
    return spark.createDataFrame(report, drift.REPORT_SCHEMA)


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    epochs, schemas, report = _drift(spark, sf)
    columns = drift.unified_columns(schemas, report)
    return drift.unified_table(load_table(spark, sf, "complaint_feed"), epochs, "payload", "source_file", ["feed_id", "source_file", "delivered_at", "line_no"], columns)


MAKE_MODEL_COUNT, MFR_SHARE = "prior_cmpl_make_model_all", "prior_severity_share_mfr_all"


def p5_as_known(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with its stored and its right attributes."""
    cases = load_table(spark, sf, "odi_severity_cases").select("odino", "ldate", "mfr_name", "maketxt", "modeltxt", F.col(MAKE_MODEL_COUNT).alias("stored_count"), F.col(MFR_SHARE).alias("stored_share"))
    history = load_table(spark, sf, "cohort_history")
    by_model = attributes_at_event_time(cases, "ldate", history.filter("entity_kind = 'make_model'"), ["maketxt", "modeltxt"], "valid_from", "known_at", {MAKE_MODEL_COUNT: "right_count"})
    return attributes_at_event_time(by_model, "ldate", history.filter("entity_kind = 'mfr'"), ["mfr_name"], "valid_from", "known_at", {MFR_SHARE: "right_share"})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    wrong = F.array_compact(
        F.array(
            F.when(~F.col("stored_count").eqNullSafe(F.col("right_count")), F.lit(MAKE_MODEL_COUNT)),
            F.when(~F.col("stored_share").eqNullSafe(F.col("right_share")), F.lit(MFR_SHARE)),
        )
    )
    return p5_as_known(spark, sf).select("odino", F.explode(wrong).alias("field_name"))


def _labels(spark: SparkSession, sf: str) -> list[str]:
    return known_values(load_table(spark, sf, "component_labels"), ["label_text", "component_group"])


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every component of every field text, single ones too."""
    return _packed(spark, sf, 1)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, 2)


def _packed(spark: SparkSession, sf: str, least: int) -> DataFrame:
    known = _labels(spark, sf)
    parts = [packed_items(load_table(spark, sf, table), key, field, known, least).select(F.lit(table).alias("table_name"), "*") for table, key, field in (("complaints", "cmplid", "compdesc"), ("odi_component_multilabel_cases", "odino", "component_groups"))]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_chunks, p3_found, p3_report, p3_table, p5_found, p5_as_known, p7_found, p7_items)}

_P2_BASE = """
WITH v AS (SELECT source_file, cmplid, field_name, raw, trim(raw, ' ') AS t FROM (
  SELECT source_file, cmplid, 'miles' AS field_name, miles AS raw FROM complaints UNION ALL
  SELECT source_file, cmplid, 'veh_speed', veh_speed FROM complaints UNION ALL
  SELECT source_file, cmplid, 'yeartxt', yeartxt FROM complaints UNION ALL
  SELECT source_file, cmplid, 'deaths', deaths FROM complaints)),
k AS (SELECT source_file, cmplid, field_name, t, CASE
  WHEN t IS NULL OR t = '' THEN 'missing'
  WHEN NOT regexp_full_match(t, CASE field_name WHEN 'miles' THEN '[0-9]{1,7}' WHEN 'veh_speed' THEN '[0-9]{1,3}' WHEN 'yeartxt' THEN '[0-9]{4}' ELSE '[0-9]{1,2}' END) THEN 'malformed'
  WHEN try_cast(t AS BIGINT) = 0 THEN 'zero' ELSE 'valid' END AS kind FROM v),
s AS (SELECT k.source_file, field_name, load_seq, count(*) AS n, count(*) FILTER (kind = 'missing') AS m,
  count(*) FILTER (kind = 'zero') AS z, count(*) FILTER (kind = 'malformed') AS b,
  median(try_cast(t AS BIGINT)) FILTER (kind = 'valid') AS med,
  count(DISTINCT CASE WHEN kind <> 'missing' THEN t END) AS d,
  min(CASE WHEN kind IN ('valid', 'zero') THEN try_cast(t AS BIGINT) END) AS lo,
  max(CASE WHEN kind IN ('valid', 'zero') THEN try_cast(t AS BIGINT) END) AS hi
  FROM k JOIN (SELECT DISTINCT source_file, load_seq FROM source_files WHERE table_name = 'complaints') f ON f.source_file = k.source_file
  GROUP BY ALL)
"""

_P5_BASE = """
WITH c AS (SELECT row_number() OVER () AS rid, * FROM odi_severity_cases),
mm AS (SELECT rid, v FROM (SELECT rid, h.prior_cmpl_make_model_all AS v, row_number() OVER (PARTITION BY rid ORDER BY valid_from DESC, known_at DESC, h.prior_cmpl_make_model_all DESC NULLS LAST) AS k
  FROM c JOIN cohort_history h ON entity_kind = 'make_model' AND c.maketxt = h.maketxt AND c.modeltxt = h.modeltxt AND valid_from <= ldate AND known_at <= ldate) WHERE k = 1),
mf AS (SELECT rid, v FROM (SELECT rid, h.prior_severity_share_mfr_all AS v, row_number() OVER (PARTITION BY rid ORDER BY valid_from DESC, known_at DESC, h.prior_severity_share_mfr_all DESC NULLS LAST) AS k
  FROM c JOIN cohort_history h ON entity_kind = 'mfr' AND c.mfr_name = h.mfr_name AND valid_from <= ldate AND known_at <= ldate) WHERE k = 1),
r AS (SELECT odino, ldate, mfr_name, maketxt, modeltxt, prior_cmpl_make_model_all AS stored_count, prior_severity_share_mfr_all AS stored_share, mm.v AS right_count, mf.v AS right_share
  FROM c LEFT JOIN mm ON c.rid = mm.rid LEFT JOIN mf ON c.rid = mf.rid)
"""

SQL = {
    "p5_as_known": _P5_BASE + "SELECT * FROM r",
    "p5_found": _P5_BASE
    + """SELECT odino, 'prior_cmpl_make_model_all' AS field_name FROM r WHERE stored_count IS DISTINCT FROM right_count
UNION ALL SELECT odino, 'prior_severity_share_mfr_all' FROM r WHERE stored_share IS DISTINCT FROM right_share""",
    "p2_found": _P2_BASE
    + """, w AS (SELECT *, lag(n) OVER o AS pn, lag(m) OVER o AS pm, lag(z) OVER o AS pz, lag(b) OVER o AS pb, lag(med) OVER o AS pmed
  FROM s WINDOW o AS (PARTITION BY field_name ORDER BY load_seq))
SELECT DISTINCT 'violation' AS case_kind, field_name, source_file, cmplid FROM k WHERE kind = 'malformed'
UNION ALL SELECT 'null_share', field_name, source_file, '' FROM w WHERE abs(m * pn - pm * n) * 100 >= 10 * n * pn
UNION ALL SELECT 'zero_share', field_name, source_file, '' FROM w WHERE abs(z * pn - pz * n) * 100 >= 10 * n * pn
UNION ALL SELECT 'violation_share', field_name, source_file, '' FROM w WHERE abs(b * pn - pb * n) * 100 >= 5 * n * pn
UNION ALL SELECT 'median', field_name, source_file, '' FROM w WHERE field_name IN ('miles', 'veh_speed') AND (med * 2 >= pmed * 3 OR med * 3 <= pmed * 2)
""",
    "p2_profile": _P2_BASE
    + """SELECT source_file, load_seq, field_name, n AS n_rows, round(m / n, 6) AS null_rate, round(z / n, 6) AS zero_rate,
  round(b / n, 6) AS violation_rate, d AS distinct_values, lo AS min_value, hi AS max_value,
  CASE WHEN field_name IN ('miles', 'veh_speed') THEN CAST(med AS DOUBLE) END AS median_value FROM s""",
}
