"""Cleaning of raw complaint rows: one projection chain (typed, flags, nulled), no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import columns as C

DATE_COLUMNS = ("faildate", "datea", "ldate", "purch_dt", "manuf_dt")
INT_COLUMNS = ("yeartxt", "injured", "deaths", "miles", "occurences", "num_cyls", "veh_speed")
YN_COLUMNS = ("crash", "fire", "police_rpt_yn", "orig_owner_yn", "anti_brakes_yn", "cruise_cont_yn", "orig_equip_yn", "repaired_yn", "medical_attn", "vehicles_towed_yn")
UPPER_COLUMNS = (
    "mfr_name maketxt modeltxt compdesc city state vin dealer_name dealer_city dealer_state dealer_zip prod_type cmpl_type drive_train fuel_sys fuel_type trans_type "
    "dot tire_size loc_of_tire tire_fail_type seat_type restraint_type"
).split()
REQUIRED = "cmplid odino mfr_name maketxt modeltxt yeartxt crash faildate fire injured deaths compdesc city state vin datea ldate miles cdescr veh_speed dealer_state prod_type medical_attn vehicles_towed_yn".split()
YEAR_LEAST, YEAR_MOST = 1900, 2027


def require_columns(df: DataFrame, required: list[str], name: str = "table") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks required columns: {', '.join(missing)}")


def clean_complaints(df: DataFrame) -> DataFrame:
    """Typed and flagged rows. Flags are computed from typed values before any value is nulled; null in, null or false out as
    stated per flag; extra columns pass through trimmed."""
    require_columns(df, REQUIRED, "complaints")
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    typed = {}
    for c in df.columns:
        if c in DATE_COLUMNS:
            typed[c] = C.to_date(F.col(c)) if c in strings else F.col(c).cast("date")
        elif c in INT_COLUMNS:
            typed[c] = C.to_int(F.col(c)) if c in strings else F.col(c).try_cast("int")
        elif c in UPPER_COLUMNS or c in YN_COLUMNS:
            typed[c] = F.upper(C.blank_to_null(F.col(c)))
        elif c in strings:
            typed[c] = C.blank_to_null(F.col(c))
    rows = df.withColumns(typed)
    year, fail, received, added = F.col("yeartxt"), F.col("faildate"), F.col("ldate"), F.col("datea")
    valid_year = year.isNotNull() & year.between(YEAR_LEAST, YEAR_MOST)
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "source_era": C.source_era(received),
        "flag_prod_type_bad": no(~F.col("prod_type").isin(*C.PRODUCT_TYPES)),
        "flag_year_unknown": year == 9999,
        "flag_year_out_of_range": no(~year.between(YEAR_LEAST, YEAR_MOST)),
        "flag_speed_999": F.col("veh_speed") == 999,
        "flag_speed_high": F.col("veh_speed") > 200,
        "flag_miles_high": F.col("miles") > 500000,
        "flag_injured_99": F.col("injured") == 99,
        "flag_deaths_99": F.col("deaths") == 99,
        "flag_state_bad": no(~F.col("state").isin(*C.POSTAL_CODES)),
        "flag_dealer_state_bad": no(~F.col("dealer_state").isin(*C.POSTAL_CODES)),
        "flag_vin_len_bad": no(F.length("vin") != 11),
        "flag_fail_after_added": no(fail > added),
        "flag_fail_after_received": no(fail > received),
        "flag_added_before_received": no(added < received),
        "flag_date_order_bad": no(fail > added) | no(fail > received) | no(added < received),
        "flag_fail_old_new_vehicle": no(valid_year & (year >= 1990) & (F.year(fail) < 1990)),
        "flag_fail_pre_model": no(valid_year & (F.year(fail) < year - 1)),
        "flag_fail_pre_model_far": no(valid_year & (F.year(fail) < year - 5)),
    }
    flagged = rows.withColumns(flags)
    unless = lambda flag, c: F.when(~no(F.col(flag)), F.col(c))
    nulled = flagged.withColumns(
        {
            "prod_type": unless("flag_prod_type_bad", "prod_type"),
            "yeartxt": F.when(~no(F.col("flag_year_unknown")) & ~F.col("flag_year_out_of_range"), year),
            "veh_speed": unless("flag_speed_999", "veh_speed"),
            "injured": unless("flag_injured_99", "injured"),
            "deaths": unless("flag_deaths_99", "deaths"),
            "state": unless("flag_state_bad", "state"),
            "dealer_state": unless("flag_dealer_state_bad", "dealer_state"),
        }
    )
    return add_severity(add_lag(zero_rules(nulled)))


def zero_rules(df: DataFrame) -> DataFrame:
    """Zero counts as not stated: flagged, nulled, and then missing."""
    out = {}
    for c in ("miles", "veh_speed"):
        out[f"{c}_zero_flag"] = F.coalesce(F.col(c) == 0, F.lit(False))
        out[f"{c}_missing_flag"] = F.nullif(F.col(c), F.lit(0)).isNull()
        out[c] = F.nullif(F.col(c), F.lit(0))
    return df.withColumns(out)


def add_lag(df: DataFrame) -> DataFrame:
    fail, received, year = F.col("faildate"), F.col("ldate"), F.col("yeartxt")
    trusted = C.trusted_fail_date(fail, received, year)
    return df.withColumns({"faildate_trusted_flag": trusted, "faildate_untrusted_flag": ~trusted, "lag_days_safe": C.safe_lag(fail, received, year)})


def add_severity(df: DataFrame, primary: str = "severity_primary_flag", broad: str = "severity_broad_flag") -> DataFrame:
    first = C.severity_primary(F.col("deaths"), F.col("injured"), F.col("fire"), F.col("crash"))
    return df.withColumn(primary, first).withColumn(broad, C.severity_broad(F.col(primary), F.col("medical_attn"), F.col("vehicles_towed_yn")))


AUDIT_PREFIXES = ("flag_", "miles_zero", "veh_speed_zero", "miles_missing", "veh_speed_missing", "faildate_trusted", "faildate_untrusted", "lag_days", "severity_")


def split_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned values, and beside them the audit columns under the row's identifiers."""
    audit = [c for c in df.columns if c.startswith(AUDIT_PREFIXES)]
    return df.drop(*audit), df.select("cmplid", "odino", "source_era", *audit)


def merge_audit(values: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows with their audit columns again, one to one on (cmplid, odino)."""
    assert_unique(audit, ["cmplid", "odino"])
    fresh = [c for c in audit.columns if c not in values.columns]
    keys = audit.select(F.col("cmplid").alias("_c"), F.col("odino").alias("_o"), *fresh)
    return values.join(keys, values["cmplid"].eqNullSafe(keys["_c"]) & values["odino"].eqNullSafe(keys["_o"]), "left").drop("_c", "_o")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Join-cardinality guard: raises, naming up to five repeated keys."""
    again = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"keys {keys} repeat, as in {[tuple(r[:-1]) for r in again]}")


def component_rows(df: DataFrame, sizes: bool = True) -> DataFrame:
    """Vehicle rows with a component: normalised label, group, drop reason and, if asked for, size of the group among kept rows."""
    rows = df.filter((F.col("prod_type") == "V") & F.col("compdesc").isNotNull())
    label = C.component_label(F.col("compdesc"))
    parent = F.trim(F.split(F.col("component_label"), ":", 2)[0])
    rows = rows.withColumn("component_label", label).withColumn("component_parent", parent).withColumn("component_group", C.component_group(F.col("component_label")))
    reason = (
        F.when(F.col("component_group") == "UNKNOWN OR OTHER", "unknown")
        .when(F.col("component_parent").isin("EQUIPMENT", "EQUIPMENT ADAPTIVE/MOBILITY"), "equipment")
        .when(F.col("component_parent").isin(*C.CHILD_SEAT_PARENTS), "child_restraint")
    )
    rows = rows.withColumn("component_drop_reason", reason).withColumn("component_keep_flag", F.col("component_drop_reason").isNull())
    if not sizes:
        return rows
    counted = rows.filter("component_keep_flag").groupBy("component_group").agg(F.count(F.lit(1)).alias("component_group_rows"))
    return rows.join(counted, "component_group", "left")  # a handful of groups: planned as a broadcast by its size
