"""Cleaning and case collapse on the documented fixtures."""

from __future__ import annotations

import datetime as dt

import pytest

from caseloom.functions import columns as C
from caseloom.operators import cases, cleaning

COLUMNS = "cmplid odino mfr_name maketxt modeltxt yeartxt crash faildate fire injured deaths compdesc city state vin datea ldate miles cdescr veh_speed dealer_state prod_type medical_attn vehicles_towed_yn police_rpt_yn orig_owner_yn anti_brakes_yn cruise_cont_yn orig_equip_yn repaired_yn source_zip source_file".split()
BASE = dict(zip(COLUMNS, "1 100 mfr make model 2020 N 2020-01-01 N 0 0 ENGINE city nc 12345678901 2020-01-12 2020-01-10 10 text 5 nc V N N N N N N N N z f".split()))


def rows(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, **c}[k] for k in COLUMNS) for c in changes], ", ".join(f"{c} string" for c in COLUMNS))


def clean(spark, *changes):
    return cleaning.clean_complaints(rows(spark, *changes)).orderBy("cmplid").collect()


def test_zero_rules_and_era(spark):
    a, b = clean(spark, {"miles": "0", "veh_speed": "0"}, {"cmplid": "2", "ldate": "2025-01-10"})
    assert a["miles_zero_flag"] and a["veh_speed_zero_flag"] and a["miles"] is None and a["miles_missing_flag"]
    assert (a["source_era"], b["source_era"]) == (C.ERA_BEFORE, C.ERA_AFTER)


def test_sentinels(spark):
    a, b, c = clean(spark, {"yeartxt": "9999"}, {"cmplid": "2", "veh_speed": "999"}, {"cmplid": "3", "faildate": "20200201", "injured": "99"})
    assert a["flag_year_unknown"] and a["flag_year_out_of_range"] and a["yeartxt"] is None
    assert b["flag_speed_999"] and b["flag_speed_high"] and b["veh_speed"] is None
    assert not c["faildate_trusted_flag"] and c["lag_days_safe"] is None and c["flag_date_order_bad"] and c["injured"] is None


def test_both_date_forms_and_rubbish(spark):
    a, b = clean(spark, {"ldate": "20200110"}, {"cmplid": "2", "ldate": "20201399", "state": "QQ"})
    assert a["ldate"] == dt.date(2020, 1, 10) and b["ldate"] is None and b["flag_state_bad"] and b["state"] is None


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="odino"):
        cleaning.clean_complaints(rows(spark, {}).drop("odino"))


def test_component_groups(spark):
    labels = spark.createDataFrame([(x,) for x in ("Engine And Engine Cooling;Radiator", "communications", "OTHER/I AM NOT SURE", "OTHER/I AM NOT SURE:X", "SERVICE BRAKES, AIR : SUPPLY", "WHEELS")], "l string")
    got = [r[0] for r in labels.select(C.component_group(C.component_label(labels.l))).collect()]
    assert got == ["ENGINE / COOLING", "COMMUNICATION", "UNKNOWN OR OTHER", "OTHER/I AM NOT SURE", "SERVICE BRAKES", "WHEELS"]


def test_collapse_mixes_first_values_and_rebuilds_marks(spark):
    df = cleaning.clean_complaints(rows(spark, {"maketxt": None, "fire": None}, {"cmplid": "2", "maketxt": "X", "state": None, "fire": "N"}, {"cmplid": "3", "odino": "101", "fire": "Y", "compdesc": "LANE DEPARTURE"}, {"cmplid": "4", "odino": "101", "compdesc": "ELECTRONIC STABILITY CONTROL (ESC)"}))
    out = {r["odino"]: r for r in cases.collapse_cases(cleaning.component_rows(df).filter("component_keep_flag"), "multi").collect()}
    assert (out["100"]["maketxt"], out["100"]["state"], out["100"]["fire"]) == ("X", "NC", "N")
    assert out["101"]["component_groups"] == "ELECTRONIC STABILITY CONTROL (ESC)|LANE DEPARTURE" and out["101"]["severity_primary_flag"]


def test_case_tables_keep_large_groups(spark):
    many = [{"cmplid": str(i), "odino": str(1000 + i), "compdesc": "ENGINE", "ldate": "2025-06-01"} for i in range(250)]
    many += [{"cmplid": "900", "odino": "9000", "compdesc": "PARKING BRAKE"}, {"cmplid": "901", "odino": "9001", "compdesc": "LANE DEPARTURE"}, {"cmplid": "902", "odino": "9001", "compdesc": "ELECTRONIC STABILITY CONTROL (ESC)"}]
    tables = cases.case_tables(cleaning.component_rows(cleaning.clean_complaints(rows(spark, *many))))
    assert {k: v.count() for k, v in tables.items()} == {"base": 252, "single": 251, "single_benchmark": 250, "multi": 252}


def test_best_text(spark):
    df = spark.createDataFrame(
        [("1", "11", "short", "e", dt.date(2020, 1, 1)), ("1", "12", "longer complaint narrative", "e", dt.date(2020, 1, 2)), ("1", "10", "longer complaint narrative", "e", dt.date(2020, 1, 1)), ("2", "13", "  ", "e", None), ("2", "14", None, "e", dt.date(2020, 1, 3)), ("3", "15", "N/A", "e", None)],
        "odino string, cmplid string, cdescr string, source_era string, ldate date",
    )
    out = {r["odino"]: r for r in cases.best_text(df).collect()}
    assert out["1"]["cdescr_model_text"] == "longer complaint narrative" and out["1"]["ldate"] == dt.date(2020, 1, 1)
    assert out["2"]["cdescr_missing_flag"] and out["2"]["cdescr_model_text"] == "" and out["2"]["cdescr_word_count"] == 0
    assert out["3"]["cdescr_placeholder_flag"] and out["3"]["cdescr_model_text"] == ""


def test_audit_split_and_merge(spark):
    df = cleaning.clean_complaints(rows(spark, {}, {"cmplid": "2"}))
    values, audit = cleaning.split_audit(df)
    assert not any(c.startswith("flag_") for c in values.columns) and "flag_state_bad" in audit.columns
    assert sorted(cleaning.merge_audit(values, audit).columns) == sorted(df.columns)
    with pytest.raises(ValueError, match="repeat"):
        cleaning.merge_audit(values, audit.union(audit))


def test_strict_booleans(spark):
    df = spark.createDataFrame([("Yes",), ("0",), (None,)], "v string")
    assert [r[0] for r in df.select(C.coerce_bool(df.v)).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        odd = spark.createDataFrame([("maybe",)], "v string")
        odd.select(C.coerce_bool(odd.v)).collect()
