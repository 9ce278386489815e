"""Queries p1, p4, p6, p8, p9 and p10, and SQL where SQL can express them."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, packing, pii, reading, survivor, terms
from caseloom.operators.packed import known_values
from caseloom.session import load_table, materialize, ship_package, spread

SURVIVOR_PATTERNS = {"miles": "[0-9]{1,7}", "veh_speed": "[0-9]{1,3}", "yeartxt": "[0-9]{4}", "deaths": "[0-9]{1,2}", "injured": "[0-9]{1,2}"}


#: Key of the pseudonyms; give another one in production (the query's result does not depend on it, the redacted text does).
PII_KEY = b"caseloom-demo-key"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The mentions that p1_redacted replaces, of the kinds asked for (birth dates are no kind of their own there)."""
    rows = pii.mentions(load_table(spark, sf, "complaints"), "cmplid", "cdescr", PII_KEY)
    return rows.filter(F.col("kind") != pii.BIRTH_DATE).select("cmplid", F.col("kind").alias("pii_kind"), "start_pos")


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load_table(spark, sf, "complaints").select("cmplid", "cdescr")).select("cmplid", pii.redact_column(F.col("cdescr"), PII_KEY).alias("cdescr"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    counted, total = terms.term_frequencies(load_table(spark, sf, "complaints"), "cdescr")
    return terms.mark_terms(counted, total).filter("verdict <> 'usual'").select("term", "verdict")


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    counted, total = terms.term_frequencies(load_table(spark, sf, "complaints"), "cdescr")
    return terms.mark_terms(counted, total)


def _labels(spark: SparkSession, sf: str) -> list[str]:
    return known_values(load_table(spark, sf, "component_labels"), ["label_text", "component_group"])


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the loads, a row each, written once."""
    loads = load_table(spark, sf, "source_files").filter("table_name = 'complaints'").select("source_file", "delivered_at")
    trust = survivor.load_trust(load_table(spark, sf, "complaints"), "source_file", SURVIVOR_PATTERNS)
    return materialize(survivor.load_weights(loads, trust), "load-weights")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.duplicate_pairs(load_table(spark, sf, "complaints"), "cmplid", "odino", "compdesc", _labels(spark, sf), "source_file", _weights(spark, sf))


def p6_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.survivors(load_table(spark, sf, "complaints"), "cmplid", "odino", "compdesc", _labels(spark, sf), "source_file", _weights(spark, sf), SURVIVOR_PATTERNS)


def p6_trust(spark: SparkSession, sf: str) -> DataFrame:
    """The trust in each load that weighs the votes."""
    return survivor.load_trust(load_table(spark, sf, "complaints"), "source_file", SURVIVOR_PATTERNS).withColumnRenamed("_src", "source_file")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return spread(load_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", bpe.encode_column(F.col("text"), bpe.ship_file(spark, bpe.vocabulary_path("byte_bpe_50k"))).alias("ids"))


def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_texts(spark, load_table(spark, sf, "documents"), "doc_id", "text", load_table(spark, sf, "pack_specs"))
    return packed.withColumn("doc_id", F.col("item_key").cast("long")).drop("item_key")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    specs = load_table(spark, sf, "pack_specs")
    return packing.packing_report(packing.pack_texts(spark, load_table(spark, sf, "documents"), "doc_id", "text", specs), specs)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(load_table(spark, sf, "documents"), "doc_id", "text", "lang", "en", load_table(spark, sf, "reading_labels"), "doc_id", "band")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "band")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_terms, p6_found, p6_survivors, p6_trust, p8_ids, p9_packed, p9_report, p10_found, p10_levels)}

_P4 = r"""
WITH t AS (SELECT rid, unnest(regexp_extract_all(lower(cdescr), '[\p{L}\p{N}]{2,}')) AS term
  FROM (SELECT row_number() OVER () AS rid, cdescr FROM complaints WHERE cdescr IS NOT NULL)),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM t GROUP BY term),
v AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 > (SELECT count(cdescr) FROM complaints) THEN 'common' ELSE 'usual' END AS verdict FROM c)
"""

_P6_TRUST = "SELECT source_file, round(sum(" + " + ".join(f"coalesce(regexp_full_match(trim({f}, ' '), '{p}'), false)::INT" for f, p in SURVIVOR_PATTERNS.items()) + f") / (count(*) * {len(SURVIVOR_PATTERNS)}), 6) AS trust FROM complaints GROUP BY source_file"

SQL = {"p6_trust": _P6_TRUST, "p4_found": _P4 + "SELECT term, verdict FROM v WHERE verdict <> 'usual'", "p4_terms": _P4 + "SELECT * FROM v"}

MODULES = [SimpleNamespace(QUERIES=QUERIES, SQL=SQL)]
