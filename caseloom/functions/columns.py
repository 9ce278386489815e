"""Row-level column expressions: trimming, typed parsing, flags, labels, regions, ages. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain lists that results must agree on.
POSTAL_CODES = (
    "AA AE AK AL AP AR AS AZ CA CO CT DC DE FL FM GA GU HI IA ID IL IN KS KY LA MA MD ME MH MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR PW RI SC SD TN TX UT VA VI VT WA WI WV WY"
).split()
REGIONS = {
    "NORTHEAST": "CT ME MA NH RI VT NJ NY PA",
    "MIDWEST": "IL IN MI OH WI IA KS MN MO NE ND SD",
    "SOUTH": "DE FL GA MD NC SC VA DC WV AL KY MS TN AR LA OK TX",
    "WEST": "AZ CO ID MT NV NM UT WY AK CA HI OR WA",
    "TERRITORY": "AS FM GU MH MP PR PW VI",
    "MILITARY": "AA AE AP",
}
PRODUCT_TYPES = ("C", "E", "T", "V")
CHILD_SEAT_PARENTS = ("CHEST CLIP, BUCKLE, HARNESS", "CARRY HANDLE, SHELL, BASE", "CHILD SEAT", "TETHER, LOWER ANCHOR (ON CAR SEAT OR VEHICLE)", "I SUSPECT THE CAR SEAT IS COUNTERFEIT", "INSERT, PADDING")
UNKNOWN_LABELS = ("UNKNOWN OR OTHER", "OTHER/I AM NOT SURE")
GROUP_PARENTS = {
    "COMMUNICATION": ("COMMUNICATION", "COMMUNICATIONS"),
    "ENGINE / COOLING": ("ENGINE", "ENGINE AND ENGINE COOLING"),
    "VISIBILITY / WIPER": ("VISIBILITY", "VISIBILITY/WIPER"),
    "FUEL / PROPULSION": ("FUEL/PROPULSION SYSTEM", "FUEL SYSTEM, GASOLINE", "FUEL SYSTEM, DIESEL", "FUEL SYSTEM, OTHER", "HYBRID PROPULSION SYSTEM"),
    "SERVICE BRAKES": ("SERVICE BRAKES", "SERVICE BRAKES, HYDRAULIC", "SERVICE BRAKES, AIR", "SERVICE BRAKES, ELECTRIC"),
}
ERA_START = "2021-05-17"
ERA_BEFORE, ERA_AFTER = "pre_2021_schema_change", "post_2021_schema_change"
AGE_BUCKETS = ((0, "AGE_0"), (3, "AGE_1_3"), (7, "AGE_4_7"), (12, "AGE_8_12"), (200, "AGE_13_PLUS"))
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PLACEHOLDERS = ("N/A", "NA", "NONE", "NO DESCRIPTION", "NO DESCRIPTION PROVIDED", "UNKNOWN", "UNK", "TEST", "TEST TEST")


def strip(c: Column) -> Column:
    """Without outer Unicode white space; a character set is trimmed far faster than a pattern matches."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Outer white space gone, inner runs to one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def to_date(c: Column) -> Column:
    """A date written yyyyMMdd, yyyy-MM-dd or yyyy/MM/dd, else null."""
    t = strip(c)
    return F.coalesce(
        F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
        F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(t, "yyyy/MM/dd")),
    )


def to_int(c: Column) -> Column:
    """A whole number (also one written with a decimal tail of zeros), else null."""
    t = strip(c)
    return F.when(t.rlike(r"^-?\d{1,9}(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("int"))


def coerce_bool(c: Column, strict: bool = True) -> Column:
    """Yes / no words to a boolean; an unknown word is an error when strict, else false."""
    t = F.lower(strip(c.cast("string")))
    otherwise = F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean") if strict else F.lit(False)
    return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n", ""), False).when(t.isNull(), F.lit(None) if strict else F.lit(False)).otherwise(otherwise)


def source_era(day: Column) -> Column:
    return F.when(day < F.lit(ERA_START).cast("date"), ERA_BEFORE).when(day >= F.lit(ERA_START).cast("date"), ERA_AFTER)


def trusted_fail_date(faildate: Column, ldate: Column, year: Column) -> Column:
    """Failure not after receipt, and not earlier than the year before the model year; never null."""
    return F.coalesce((faildate <= ldate) & (year.isNull() | (F.year(faildate) >= year - 1)), F.lit(False))


def safe_lag(faildate: Column, ldate: Column, year: Column) -> Column:
    return F.when(trusted_fail_date(faildate, ldate, year), F.datediff(ldate, faildate))


def severity_primary(deaths: Column, injured: Column, fire: Column, crash: Column) -> Column:
    yes = lambda c: F.coalesce(c == "Y", F.lit(False))
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    return some(deaths) | some(injured) | yes(fire) | yes(crash)


def severity_broad(primary: Column, medical: Column, towed: Column) -> Column:
    return primary | F.coalesce(medical == "Y", F.lit(False)) | F.coalesce(towed == "Y", F.lit(False))


def component_label(c: Column) -> Column:
    """Upper case, semicolons as colons, no spaces around colons, single spaces."""
    t = F.regexp_replace(F.upper(c), r"(?U)\s*[;:]\s*", ":")
    return squeeze(t)


def component_group(label: Column) -> Column:
    """The group of a normalised label: the part before its first colon, with synonyms joined; unknown labels by whole label."""
    parent = F.trim(F.split(label, ":", 2)[0])
    out = F.when(label.isin(*UNKNOWN_LABELS), UNKNOWN_LABELS[0])
    for group, parents in GROUP_PARENTS.items():
        out = out.when(parent.isin(*parents), group)
    return out.otherwise(parent)


def region(state: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, codes in REGIONS.items():
        out = out.when(state.isin(*codes.split()), name)
    return out.otherwise("UNKNOWN")


def vehicle_age(day: Column, model_year: Column) -> Column:
    age = F.year(day) - model_year
    return F.when(age >= 0, age)


def age_bucket(age: Column) -> Column:
    out = F.when(age < 0, None)
    for upto, label in AGE_BUCKETS:
        out = out.when(age <= upto, label)
    return out


def is_placeholder(text: Column) -> Column:
    """A text that says nothing: a stock phrase, or ten characters or less without a letter; blank text is not one."""
    t = F.upper(strip(text))
    return F.coalesce((t != "") & (t.isin(*PLACEHOLDERS) | ((F.length(t) <= 10) & ~t.rlike("[A-Z]"))), F.lit(False))


def word_count(text: Column) -> Column:
    t = squeeze(text)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def format_year(year: Column) -> Column:
    """A year as whole-number text, other texts as they are, null as Unknown."""
    return F.coalesce(year.cast("string").try_cast("double").cast("int").cast("string"), year.cast("string"), F.lit("Unknown"))
