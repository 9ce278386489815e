"""SQL equivalents of the relational queries."""

from __future__ import annotations

from caseloom.functions import columns as C
from caseloom.functions import text as X
from caseloom.functions.patterns import compact


def _date(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '\\d{{8}}') THEN CAST(try_strptime(trim({c}), '%Y%m%d') AS DATE) WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime(trim({c}), '%Y-%m-%d') AS DATE) WHEN regexp_full_match(trim({c}), '\\d{{4}}/\\d{{2}}/\\d{{2}}') THEN CAST(try_strptime(trim({c}), '%Y/%m/%d') AS DATE) END"


def _int(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '-?[0-9]{{1,9}}(\\.0+)?') THEN try_cast(regexp_replace(trim({c}), '\\.0+$', '') AS INTEGER) END"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_UP = lambda c: f"upper(nullif(trim({c}), ''))"
_YN = "crash fire police_rpt_yn orig_owner_yn anti_brakes_yn cruise_cont_yn orig_equip_yn repaired_yn medical_attn vehicles_towed_yn".split()

_CLEAN = (
    "WITH t AS (SELECT nullif(trim(cmplid), '') AS cmplid, nullif(trim(odino), '') AS odino, "
    + ", ".join(f"{_UP(c)} AS {c}" for c in ["mfr_name", "maketxt", "modeltxt", "compdesc", "city", "state", "vin", "dealer_state", "prod_type", *_YN])
    + f", {_date('faildate')} AS faildate, {_date('datea')} AS datea, {_date('ldate')} AS ldate, "
    + ", ".join(f"{_int(c)} AS {c}" for c in ("yeartxt", "injured", "deaths", "miles", "veh_speed"))
    + ", nullif(regexp_replace(cdescr, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '') AS cdescr, source_file, source_zip FROM complaints),\n"
    + f"""f AS (SELECT *, CASE WHEN ldate < DATE '{C.ERA_START}' THEN '{C.ERA_BEFORE}' WHEN ldate >= DATE '{C.ERA_START}' THEN '{C.ERA_AFTER}' END AS source_era,
  coalesce(prod_type NOT IN ({_list(C.PRODUCT_TYPES)}), false) AS bad_type, coalesce(NOT yeartxt BETWEEN 1900 AND 2027, false) AS flag_year_out_of_range,
  veh_speed = 999 AS flag_speed_999, injured = 99 AS bad_injured, deaths = 99 AS bad_deaths,
  coalesce(state NOT IN ({_list(C.POSTAL_CODES)}), false) AS flag_state_bad, coalesce(length(vin) <> 11, false) AS flag_vin_len_bad,
  coalesce(faildate > datea, false) OR coalesce(faildate > ldate, false) OR coalesce(datea < ldate, false) AS flag_date_order_bad,
  coalesce(yeartxt BETWEEN 1900 AND 2027 AND year(faildate) < yeartxt - 1, false) AS flag_fail_pre_model,
  coalesce(miles = 0, false) AS miles_zero_flag FROM t),
n AS (SELECT * REPLACE (CASE WHEN NOT bad_type THEN prod_type END AS prod_type, CASE WHEN NOT flag_year_out_of_range THEN yeartxt END AS yeartxt,
  nullif(CASE WHEN NOT coalesce(flag_speed_999, false) THEN veh_speed END, 0) AS veh_speed, CASE WHEN NOT coalesce(bad_injured, false) THEN injured END AS injured,
  CASE WHEN NOT coalesce(bad_deaths, false) THEN deaths END AS deaths, CASE WHEN NOT flag_state_bad THEN state END AS state, nullif(miles, 0) AS miles) FROM f),
l AS (SELECT *, coalesce(faildate <= ldate AND (yeartxt IS NULL OR year(faildate) >= yeartxt - 1), false) AS faildate_trusted_flag,
  coalesce(deaths > 0, false) OR coalesce(injured > 0, false) OR coalesce(fire = 'Y', false) OR coalesce(crash = 'Y', false) AS severity_primary_flag FROM n),
clean AS (SELECT *, CASE WHEN faildate_trusted_flag THEN date_diff('day', faildate, ldate) END AS lag_days_safe,
  severity_primary_flag OR coalesce(medical_attn = 'Y', false) OR coalesce(vehicles_towed_yn = 'Y', false) AS severity_broad_flag FROM l)
"""
)

_GROUP = "CASE WHEN lab IN (" + _list(C.UNKNOWN_LABELS) + f") THEN '{C.UNKNOWN_LABELS[0]}' " + " ".join(f"WHEN par IN ({_list(p)}) THEN '{g}'" for g, p in C.GROUP_PARENTS.items()) + " ELSE par END"
_COMPONENTS = (
    _CLEAN
    + f""", lb AS (SELECT *, trim(regexp_replace(regexp_replace(upper(compdesc), '\\s*[;:]\\s*', ':', 'g'), '\\s+', ' ', 'g'), ' ') AS lab FROM clean WHERE prod_type = 'V' AND compdesc IS NOT NULL),
pp AS (SELECT *, trim(split_part(lab, ':', 1)) AS par FROM lb),
cg AS (SELECT *, {_GROUP} AS component_group FROM pp),
cr AS (SELECT *, CASE WHEN component_group = 'UNKNOWN OR OTHER' THEN 'unknown' WHEN par IN ('EQUIPMENT', 'EQUIPMENT ADAPTIVE/MOBILITY') THEN 'equipment' WHEN par IN ({_list(C.CHILD_SEAT_PARENTS)}) THEN 'child_restraint' END AS component_drop_reason FROM cg),
kept AS (SELECT * FROM cr WHERE component_drop_reason IS NULL)
"""
)


def _first(c: str) -> str:
    return f"(min({{'n': cmplid IS NULL, 'k': cmplid, 'v': {c}}}) FILTER ({c} IS NOT NULL)).v"


def _yes(c: str) -> str:
    return f"CASE WHEN coalesce(bool_or({c} = 'Y'), false) THEN 'Y' WHEN count({c}) > 0 THEN 'N' END"


_MULTI = (
    _COMPONENTS
    + f""", m0 AS (SELECT odino, count(*) AS component_row_count, string_agg(DISTINCT component_group, '|' ORDER BY component_group) AS component_groups, count(DISTINCT component_group) AS component_group_count,
  {', '.join(f'{_first(c)} AS {c}' for c in ('mfr_name', 'maketxt', 'yeartxt', 'state', 'ldate', 'faildate'))},
  max(miles) AS miles, max(veh_speed) AS veh_speed, max(injured) AS injured, max(deaths) AS deaths, {', '.join(f'{_yes(c)} AS {c}' for c in _YN)}
  FROM kept WHERE odino IS NOT NULL GROUP BY odino),
multi AS (SELECT *, CASE WHEN coalesce(faildate <= ldate AND (yeartxt IS NULL OR year(faildate) >= yeartxt - 1), false) THEN date_diff('day', faildate, ldate) END AS lag_days_safe,
  coalesce(deaths > 0, false) OR coalesce(injured > 0, false) OR coalesce(fire = 'Y', false) OR coalesce(crash = 'Y', false) AS severity_primary_flag FROM m0),
mc AS (SELECT *, severity_primary_flag OR coalesce(medical_attn = 'Y', false) OR coalesce(vehicles_towed_yn = 'Y', false) AS severity_broad_flag FROM multi)
"""
)

_SQUEEZE = "trim(regexp_replace(cdescr, '[\\s\\p{Z}]+', ' ', 'g'), ' ')"
_BEST = (
    _CLEAN
    + f""", bt AS (SELECT odino, cdescr, coalesce({_SQUEEZE}, '') AS norm, ldate, {{'a': ldate IS NULL, 'b': ldate, 'c': try_cast(cmplid AS BIGINT) IS NULL, 'd': try_cast(cmplid AS BIGINT), 'e': cmplid}} AS early FROM clean WHERE odino IS NOT NULL),
bp AS (SELECT odino, coalesce(arg_min(norm, {{'z': -length(norm), 'e': early}}) FILTER (norm <> ''), arg_min(norm, early)) AS norm,
  coalesce(arg_min(ldate, {{'z': -length(norm), 'e': early}}) FILTER (norm <> '' AND ldate IS NOT NULL), arg_min(ldate, early) FILTER (ldate IS NOT NULL)) AS ldate FROM bt GROUP BY odino),
bq AS (SELECT *, coalesce(norm <> '' AND (upper(norm) IN ({_list(C.PLACEHOLDERS)}) OR (length(norm) <= 10 AND NOT regexp_matches(upper(norm), '[A-Z]'))), false) AS ph FROM bp),
best AS (SELECT odino, CASE WHEN ph THEN '' ELSE norm END AS model_text, norm = '' AS missing, ph, ldate FROM bq)
"""
)

_TOPIC = """
WITH g AS (SELECT odino, mfr_name, maketxt, modeltxt, yeartxt, state, date_trunc('month', ldate)::DATE AS month, trim(unnest(string_split(component_groups, '|')), ' ') AS component_group, severity_broad_flag, severity_primary_flag
  FROM odi_component_multilabel_cases WHERE ldate IS NOT NULL AND component_groups IS NOT NULL),
tr AS (SELECT *, ascii(component_group) % 20 AS topic_id, 'topic ' || (ascii(component_group) % 20) AS topic_label, CASE WHEN ascii(component_group) % 20 = 5 THEN 'recall_process' ELSE 'defect' END AS topic_category,
  CASE WHEN ascii(component_group) % 20 = 5 THEN 'process' WHEN ascii(component_group) % 20 IN (0, 14) THEN 'caution' ELSE 'defect_watchlist' END AS watchlist_group, length(component_group) / 50 AS topic_strength FROM g WHERE component_group <> '')
"""
_KEYS = "maketxt, modeltxt, yeartxt, component_group, topic_id, topic_label, topic_category, watchlist_group"
_JOIN = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in _KEYS.split(", "))
_SERIES = (
    _TOPIC
    + f""", mo AS (SELECT month, {_KEYS}, count(DISTINCT odino) AS complaints, count(DISTINCT state) AS unique_states, avg(topic_strength) AS strength, avg(severity_broad_flag::INT) AS broad, avg(severity_primary_flag::INT) AS crit FROM tr GROUP BY ALL),
sp AS (SELECT {_KEYS}, min(month) AS f, (SELECT max(month) FROM mo) AS l FROM mo GROUP BY ALL),
gr AS (SELECT {_KEYS}, unnest(generate_series(f, l, INTERVAL 1 MONTH))::DATE AS month FROM sp),
se AS (SELECT a.*, coalesce(b.complaints, 0) AS complaints, coalesce(b.unique_states, 0) AS unique_states, coalesce(b.strength, 0) AS strength, coalesce(b.broad, 0) AS broad, coalesce(b.crit, 0) AS crit
  FROM gr a LEFT JOIN mo b ON a.month = b.month AND {_JOIN}),
gw AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(complaints) OVER w END AS ra, CASE WHEN count(*) OVER w >= 3 THEN sum(complaints) OVER w END AS rs FROM se
  WINDOW w AS (PARTITION BY {_KEYS} ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
em AS (SELECT *, CASE WHEN ra IS NOT NULL THEN complaints / greatest(ra, 1) END AS gv, complaints - coalesce(ra, 0) AS gd, coalesce(rs, 0) = 0 AND complaints >= 3 AS nw FROM gw),
series AS (SELECT *, coalesce(gv >= 2, false) OR nw AS emerging, ln(1 + complaints) * greatest(least(coalesce(gv, 1), 4), 0.5) * CASE WHEN nw THEN 1.35 ELSE 1.0 END * (1 + 0.75 * broad) * (1 + 0.6 * crit)
  * (0.75 + greatest(least(strength, 1), 0)) * CASE watchlist_group WHEN 'defect_watchlist' THEN 1.0 WHEN 'caution' THEN 0.65 WHEN 'process' THEN 0.45 ELSE 0.6 END AS score FROM em),
meta AS (SELECT {_KEYS}, coalesce(string_agg(DISTINCT nullif(trim(mfr_name), ''), ' | ' ORDER BY nullif(trim(mfr_name), '')), '') AS mfr_name FROM tr GROUP BY ALL),
sm AS (SELECT a.*, b.mfr_name FROM series a JOIN meta b ON {_JOIN}),
watch AS (SELECT *, CASE WHEN complaints >= 10 AND coalesce(gv >= 2, false) THEN 'High-confidence signal' WHEN complaints >= 5 AND (coalesce(gv >= 2, false) OR nw) THEN 'Moderate signal' ELSE 'Early signal' END AS signal_tier,
  coalesce(yeartxt::VARCHAR, 'Unknown') AS yt FROM sm WHERE watchlist_group = 'defect_watchlist' AND complaints >= 3 AND emerging)
"""
)
_COARSE = _SERIES.replace("SELECT odino, mfr_name, maketxt, modeltxt, yeartxt, state,", "SELECT odino, mfr_name, maketxt, CAST(NULL AS VARCHAR) AS modeltxt, CAST(NULL AS INTEGER) AS yeartxt, state,")
_RISK_TEXT = "CASE WHEN broad >= 0.35 THEN 'high severity rate' END, CASE WHEN crit >= 0.25 THEN 'critical event while in operation' END, CASE WHEN strength >= 0.45 THEN 'strong topic match' END"

_SCORES = """
WITH s AS (SELECT odino, year(ldate) AS yr, severity_primary_flag AS truth, (coalesce(veh_speed, 20) % 100) / 125 + CASE WHEN severity_primary_flag THEN 0.125 ELSE 0 END AS score
  FROM odi_severity_cases WHERE severity_primary_flag IS NOT NULL AND odino IS NOT NULL AND ldate IS NOT NULL)
"""
_SCORES = _SCORES.replace("/ 125", "/ 125::DOUBLE").replace("0.125 ELSE 0", "0.125::DOUBLE ELSE 0::DOUBLE")
_LABELS = """
WITH y AS (SELECT odino, list_filter(string_split(component_groups, '|'), lambda x: x <> '') AS labels FROM odi_component_multilabel_cases WHERE component_groups IS NOT NULL),
z AS (SELECT odino, labels, labels[1] AS truth, labels[-1] AS predicted FROM y WHERE len(labels) > 0)
"""
_FLAG_NAMES = ["flag_year_out_of_range", "flag_speed_999", "flag_state_bad", "flag_vin_len_bad", "flag_date_order_bad", "flag_fail_pre_model", "miles_zero_flag", "faildate_trusted_flag", "severity_primary_flag", "severity_broad_flag"]


def _drift() -> str:
    number = lambda c, z: f"SELECT era, n AS row_count, '{c}' AS field_name, 'number' AS field_kind, {c}_p AS present_count, {z} AS zero_or_no_count, round({c}_m, 6) AS mean_value, round({c}_h, 6) AS median_value, round(1 - {c}_p / n, 6) AS null_rate FROM w"
    mark = lambda c: f"SELECT era, n, '{c}', 'yes_no', {c}_p, {c}_z, round({c}_m, 6), CAST(NULL AS DOUBLE), round(1 - {c}_p / n, 6) FROM w"
    nums, marks = ("miles", "veh_speed", "injured", "deaths", "yeartxt"), ("crash", "fire", "medical_attn", "vehicles_towed_yn")
    zero = {"miles": "count(*) FILTER (miles_zero_flag)", "veh_speed": "count(*) FILTER (speed_zero)"}
    cols = [f"count({c}) AS {c}_p, {zero.get(c, f'count(*) FILTER ({c} = 0)')} AS {c}_z, avg({c}) AS {c}_m, quantile_cont({c}, 0.5) AS {c}_h" for c in nums]
    cols += [f"count({c}) AS {c}_p, count(*) FILTER ({c} = 'N') AS {c}_z, avg(({c} = 'Y')::INT) AS {c}_m" for c in marks]
    base = _CLEAN.replace("coalesce(miles = 0, false) AS miles_zero_flag", "coalesce(miles = 0, false) AS miles_zero_flag, coalesce(veh_speed = 0, false) AS speed_zero")
    head = base + f", w AS (SELECT CASE WHEN grouping(source_era) = 1 THEN 'overall' ELSE coalesce(source_era, 'unknown') END AS era, count(*) AS n, {', '.join(cols)} FROM clean GROUP BY GROUPING SETS ((), (source_era)))\n"
    return head + " UNION ALL ".join([number(c, f"{c}_z") for c in nums] + [mark(c) for c in marks])


def _history() -> str:
    keys = {"make_model": ["maketxt", "modeltxt"], "mfr": ["mfr_name"], "make_model_year": ["maketxt", "modeltxt", "yeartxt"]}
    ctes, selects, joins = [], [], []
    for name, ks in keys.items():
        k = ", ".join(ks)
        ctes.append(f"d_{name} AS (SELECT {k}, ldate::DATE AS d, count(*) AS n, count(*) FILTER (severity_primary_flag) AS s FROM odi_severity_cases GROUP BY ALL), h_{name} AS (SELECT {k}, d, coalesce(sum(n) OVER w, 0) AS c, coalesce(sum(s) OVER w, 0) AS v FROM d_{name} WINDOW w AS (PARTITION BY {k} ORDER BY d NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        selects.append(f"h_{name}.c AS prior_count_{name}, h_{name}.v / nullif(h_{name}.c, 0) AS prior_share_{name}")
        joins.append(f"LEFT JOIN h_{name} ON " + " AND ".join([f"o.{x} IS NOT DISTINCT FROM h_{name}.{x}" for x in ks] + [f"o.ldate::DATE IS NOT DISTINCT FROM h_{name}.d"]))
    return f"WITH {', '.join(ctes)} SELECT o.odino, {', '.join(selects)} FROM odi_severity_cases o {' '.join(joins)}"


_CONFLICT = ("mfr_name", "maketxt", "modeltxt", "state", "miles", "veh_speed", "ldate")
_AUDIT = "cmplid odino mfr_name maketxt modeltxt yeartxt crash faildate fire injured deaths compdesc city state vin datea ldate miles cdescr veh_speed dealer_state prod_type medical_attn vehicles_towed_yn police_rpt_yn orig_owner_yn anti_brakes_yn cruise_cont_yn orig_equip_yn repaired_yn source_zip source_file".split()
_OUT = ("miles", "veh_speed", "lag_days_safe", "row_count")
_CHECKS = [("ldate", "date"), ("faildate", "date"), ("datea", "date")]


def _quality() -> str:
    rows = ["SELECT 'table' AS field_name, 'rows' AS check_name, count(*) AS value FROM complaints"]
    v = lambda c: f"nullif(trim({c}), '')"
    for c, _ in _CHECKS:
        zero = f"{v(c)} IN ('0', '00000000', '0000-00-00')"
        bad = f"NOT ({zero}) AND (NOT regexp_full_match({v(c)}, '[0-9]{{8}}') OR try_strptime({v(c)}, '%Y%m%d') IS NULL)"
        rows += [f"SELECT '{c}', 'present', count({v(c)}) FROM complaints", f"SELECT '{c}', 'zero', count(*) FILTER ({zero}) FROM complaints", f"SELECT '{c}', 'invalid', count(*) FILTER ({bad}) FROM complaints"]
    for c, size in (("miles", 7), ("veh_speed", 3), ("injured", 2)):
        x = f"try_cast({v(c)} AS DOUBLE)"
        rows += [f"SELECT '{c}', 'present', count({v(c)}) FROM complaints", f"SELECT '{c}', 'non_numeric', count(*) FILTER ({v(c)} IS NOT NULL AND {x} IS NULL) FROM complaints", f"SELECT '{c}', 'non_integer', count(*) FILTER (abs({x} % 1) >= 1e-9) FROM complaints", f"SELECT '{c}', 'overflow', count(*) FILTER (length(regexp_replace({v(c)}, '[^0-9]', '', 'g')) > {size}) FROM complaints"]
    for c, most in (("city", 12), ("vin", 11)):
        rows += [f"SELECT '{c}', 'max_length', max(length({c})) FROM complaints", f"SELECT '{c}', 'too_long', count(*) FILTER (length({c}) > {most}) FROM complaints"]
    for c, ok in (("crash", "'Y', 'N'"), ("prod_type", "'V', 'T', 'E', 'C'")):
        rows.append(f"SELECT '{c}', 'unexpected', count(*) FILTER (upper({v(c)}) NOT IN ({ok})) FROM complaints")
    rows += ["SELECT 'cmplid', 'null', count(*) FILTER (nullif(trim(cmplid), '') IS NULL) FROM complaints", "SELECT 'cmplid', 'repeats', count(cmplid) - count(DISTINCT cmplid) FROM complaints"]
    return " UNION ALL ".join(rows)


_RANKED = _SCORES + ", c AS (SELECT yr, score, count(*) AS n, count(*) FILTER (truth) AS p FROM s GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER d, 0) AS an, coalesce(sum(p) OVER d, 0) AS ap, sum(n) OVER (PARTITION BY yr) AS tn, sum(p) OVER (PARTITION BY yr) AS tp FROM c WINDOW d AS (PARTITION BY yr ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))\n"
_PAIRS = [("train", "valid_2025", "2025-01-01", "2026-01-01"), ("train_core", "screen_2024", "2024-01-01", "2025-01-01"), ("dev_2020_2024", "select_2025", "2025-01-01", "2027-01-01")]



def _cleaning_metrics() -> str:
    """Every metric of the cleaning summary: flags of typed values (t), and of values after the unusable ones are nulled (clean)."""
    year = "yeartxt BETWEEN 1900 AND 2027"
    typed = {
        "flag_prod_type_bad": f"prod_type NOT IN ({_list(C.PRODUCT_TYPES)})", "flag_year_unknown": "yeartxt = 9999", "flag_speed_high": "veh_speed > 200", "flag_miles_high": "miles > 500000", "flag_injured_99": "injured = 99", "flag_deaths_99": "deaths = 99",
        "flag_dealer_state_bad": f"dealer_state NOT IN ({_list(C.POSTAL_CODES)})", "flag_fail_after_added": "faildate > datea", "flag_fail_after_received": "faildate > ldate", "flag_added_before_received": "datea < ldate",
        "flag_fail_old_new_vehicle": f"{year} AND yeartxt >= 1990 AND year(faildate) < 1990", "flag_fail_pre_model_far": f"{year} AND year(faildate) < yeartxt - 5", "miles_missing_flag": "coalesce(miles, 0) = 0", "veh_speed_zero_flag": "veh_speed = 0", "veh_speed_missing_flag": "coalesce(veh_speed, 0) IN (0, 999)",
    }
    later = {**{c: c for c in _FLAG_NAMES}, "faildate_untrusted_flag": "NOT faildate_trusted_flag"}
    rows = ["SELECT 'rows' AS metric, count(*) AS value FROM t", "SELECT 'cases', count(DISTINCT odino) FROM t"]
    rows += [f"SELECT '{n}', count(*) FILTER ({e}) FROM t" for n, e in typed.items()] + [f"SELECT '{n}', count(*) FILTER ({e}) FROM clean" for n, e in later.items()]
    return _CLEAN + " UNION ALL ".join(rows)


def _context_flags() -> str:
    """Places of matches from the lengths of what lies between them; a flag never null."""
    operation, critical, highway = (compact(p) for p in (X.IN_OPERATION, X.CRITICAL, X.HIGHWAY))
    between = lambda p: f"regexp_extract_all(cdescr, '(?is)(.*?)(?:{p.removeprefix('(?i)')})', 1)"
    places = lambda n: f"list_transform(range(1, len({n}m) + 1), lambda i: coalesce(list_sum(list_transform({n}b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({n}m[1:i - 1], lambda x: length(x))), 0)) AS {n}s"
    close = "list_transform(range(1, len(cm) + 1), lambda i: len(list_filter(range(1, len(om) + 1), lambda j: abs(cs[i] - os[j]) <= 160 OR abs(cs[i] + length(cm[i]) - os[j] - length(om[j])) <= 160)) > 0)"
    speeds = f"list_max(list_transform(regexp_extract_all(cdescr, '{X.SPEED}', 1), lambda x: try_cast(x AS INTEGER)))"
    return (
        f"WITH m AS (SELECT odino, cdescr, {between(critical)} AS cb, regexp_extract_all(cdescr, '{critical}', 0) AS cm, {between(operation)} AS ob, regexp_extract_all(cdescr, '{operation}', 0) AS om, {speeds} AS max_mph FROM odi_severity_cases), "
        f"p AS (SELECT *, {places('c')}, {places('o')} FROM m) "
        f"SELECT odino, coalesce(len(om) > 0, false) AS in_operation_flag, coalesce(regexp_matches(cdescr, '{highway}'), false) AS highway_flag, max_mph, coalesce(max_mph >= 55, false) AS high_speed_flag, coalesce(list_contains({close}, true), false) AS critical_event_near_operation_flag FROM p"
    )


_SUMMARY = "month, maketxt, modeltxt, yeartxt, topic_id, topic_label"
_WATCH_SUMMARY = (
    _SERIES
    + """, de AS (SELECT tr.month, tr.maketxt, tr.modeltxt, coalesce(tr.yeartxt::VARCHAR, 'Unknown') AS yeartxt, tr.topic_id, tr.topic_label, tr.component_group, tr.odino, tr.mfr_name, tr.state, tr.topic_strength, tr.severity_broad_flag AS broad_flag, tr.severity_primary_flag AS primary_flag, w.score, w.signal_tier
  FROM tr JOIN watch w ON tr.month = w.month AND tr.maketxt IS NOT DISTINCT FROM w.maketxt AND tr.modeltxt IS NOT DISTINCT FROM w.modeltxt AND tr.yeartxt IS NOT DISTINCT FROM w.yeartxt AND tr.topic_id = w.topic_id AND tr.component_group = w.component_group),
fi AS (SELECT *, row_number() OVER (PARTITION BY """
    + _SUMMARY
    + """, odino ORDER BY score DESC, component_group) = 1 AS one FROM de)
SELECT """
    + _SUMMARY
    + """, coalesce(string_agg(DISTINCT nullif(trim(mfr_name), ''), ' | ' ORDER BY nullif(trim(mfr_name), '')), '') AS mfr_name, string_agg(DISTINCT component_group, ' | ' ORDER BY component_group) AS component_groups, count(DISTINCT odino) AS complaints, count(DISTINCT state) FILTER (one) AS unique_states,
  round(max(score), 6) AS max_component_watchlist_score, round(avg(topic_strength) FILTER (one), 6) AS avg_topic_strength, round(avg(broad_flag::INT) FILTER (one), 6) AS severity_broad_rate, round(avg(primary_flag::INT) FILTER (one), 6) AS critical_event_near_operation_rate,
  CASE max(CASE signal_tier WHEN 'High-confidence signal' THEN 3 WHEN 'Moderate signal' THEN 2 WHEN 'Early signal' THEN 1 ELSE 0 END) WHEN 3 THEN 'High-confidence signal' WHEN 2 THEN 'Moderate signal' WHEN 1 THEN 'Early signal' ELSE 'Monitor' END AS best_signal_tier FROM fi GROUP BY """
    + _SUMMARY
)

SQL = {
    "cleaning_metrics": _cleaning_metrics(),
    "context_flags": _context_flags(),
    "watchlist_summary": _WATCH_SUMMARY,
    "clean_rows": _CLEAN + f"SELECT cmplid, odino, source_file, yeartxt, ldate, faildate, miles, veh_speed, injured, deaths, state, prod_type, lag_days_safe, source_era, {', '.join(_FLAG_NAMES)} FROM clean",
    "clean_summary": _CLEAN + f"SELECT source_era, count(*) AS n_rows, count(DISTINCT odino) AS cases, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FLAG_NAMES)} FROM clean GROUP BY source_era",
    "component_groups": _COMPONENTS + "SELECT a.component_group, component_drop_reason, count(*) AS n_rows, count(DISTINCT odino) AS cases, max(b.k) AS component_group_rows FROM cr a LEFT JOIN (SELECT component_group, count(*) AS k FROM kept GROUP BY 1) b ON a.component_group = b.component_group GROUP BY 1, 2",
    "multi_cases": _MULTI + "SELECT odino, component_row_count, component_groups, component_group_count, mfr_name, maketxt, yeartxt, state, ldate, miles, veh_speed, injured, crash, fire, police_rpt_yn, lag_days_safe, severity_primary_flag, severity_broad_flag FROM mc",
    "single_cases": _MULTI + ", one AS (SELECT odino, component_groups AS component_group, ldate, component_row_count FROM mc WHERE component_group_count = 1), ft AS (SELECT component_group, count(*) AS fit_rows FROM one WHERE ldate <= DATE '2025-12-31' GROUP BY 1) SELECT odino, one.component_group, fit_rows, coalesce(fit_rows >= 250, false) AS benchmark_keep_flag, component_row_count FROM one LEFT JOIN ft ON one.component_group = ft.component_group",
    "severity_rows": _CLEAN + f", v AS (SELECT *, trim(regexp_replace(regexp_replace(upper(compdesc), '\\s*[;:]\\s*', ':', 'g'), '\\s+', ' ', 'g'), ' ') AS lab FROM clean WHERE prod_type = 'V' AND odino IS NOT NULL), q AS (SELECT odino, count(*) AS row_count, count(DISTINCT lab) AS component_count, max(miles) AS miles, max(veh_speed) AS veh_speed, max(injured) AS injured, max(deaths) AS deaths, {', '.join(f'{_yes(c)} AS {c}' for c in _YN)} FROM v GROUP BY odino), q2 AS (SELECT *, coalesce(deaths > 0, false) OR coalesce(injured > 0, false) OR coalesce(fire = 'Y', false) OR coalesce(crash = 'Y', false) AS severity_primary_flag FROM q) SELECT odino, row_count, component_count, miles, veh_speed, crash, fire, severity_primary_flag, severity_primary_flag OR coalesce(medical_attn = 'Y', false) OR coalesce(vehicles_towed_yn = 'Y', false) AS severity_broad_flag FROM q2",
    "best_texts": _BEST + "SELECT odino, md5(model_text) AS text_md5, missing AS cdescr_missing_flag, ph AS cdescr_placeholder_flag, length(model_text) AS cdescr_char_len, ldate FROM best",
    "text_conflicts": _CLEAN + f"SELECT odino, count(*) AS text_rows, count(DISTINCT nullif({_SQUEEZE}, '')) AS distinct_texts, min(ldate) AS first_date, max(ldate) AS last_date FROM clean WHERE odino IS NOT NULL GROUP BY odino HAVING count(DISTINCT nullif({_SQUEEZE}, '')) > 1",
    "text_overlap": _BEST + ", tx AS (SELECT model_text, ldate FROM best WHERE model_text <> '' AND ldate IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{p}' AS prior_split, '{n}' AS later_split, count(*) FILTER (a) AS prior_texts, count(*) FILTER (b) AS later_texts, count(*) FILTER (a AND b) AS overlap_texts, round(count(*) FILTER (a AND b) / greatest(count(*) FILTER (b), 1), 6) AS overlap_share FROM (SELECT model_text, bool_or(ldate < DATE '{cut}') AS a, bool_or(ldate >= DATE '{cut}' AND ldate < DATE '{end}') AS b FROM tx GROUP BY 1)" for p, n, cut, end in _PAIRS),
    "era_drift": _drift(),
    "conflict_summary": _CLEAN + ", pc AS (SELECT odino, " + ", ".join(f"count(DISTINCT {c}) > 1 AS {c}" for c in _CONFLICT) + " FROM clean WHERE odino IS NOT NULL GROUP BY odino) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS cases, count(*) FILTER ({c}) AS conflict_cases, round(count(*) FILTER ({c}) / greatest(count(*), 1), 6) AS conflict_rate FROM pc" for c in _CONFLICT),
    "scope_summary": _MULTI + "SELECT CASE WHEN grouping(y) = 1 THEN 'overall' ELSE coalesce(y::VARCHAR, 'unknown') END AS scope, count(*) AS cases, count(*) FILTER (component_group_count = 1) AS single_cases, count(*) FILTER (component_group_count > 1) AS multi_cases, round(count(*) FILTER (component_group_count = 1) / count(*), 6) AS single_share, round(avg(severity_primary_flag::INT), 6) AS primary_rate, round(avg(severity_broad_flag::INT), 6) AS broad_rate FROM (SELECT *, year(ldate) AS y FROM mc) GROUP BY GROUPING SETS ((), (y))",
    "group_presence": _COMPONENTS + ", pr AS (SELECT DISTINCT odino, component_group FROM kept WHERE odino IS NOT NULL AND component_group IS NOT NULL), sz AS (SELECT odino, count(*) AS k FROM pr GROUP BY 1) SELECT component_group, count(*) AS all_cases, count(*) FILTER (k = 1) AS single_cases, count(*) FILTER (k > 1) AS multi_cases, round(count(*) / (SELECT count(*) FROM sz), 6) AS case_share FROM pr JOIN sz ON pr.odino = sz.odino GROUP BY 1",
    "prior_history": _history(),
    "age_and_region": "WITH a AS (SELECT CASE " + " ".join(f"WHEN state IN ({_list(v.split())}) THEN '{k}'" for k, v in C.REGIONS.items()) + " ELSE 'UNKNOWN' END AS state_region, CASE WHEN year(ldate) - yeartxt >= 0 THEN year(ldate) - yeartxt END AS age, quarter(ldate) AS complaint_quarter FROM odi_severity_cases) SELECT state_region, CASE WHEN age < 0 THEN NULL " + " ".join(f"WHEN age <= {u} THEN '{n}'" for u, n in C.AGE_BUCKETS) + " END AS vehicle_age_bucket, complaint_quarter, count(*) AS n_rows, sum(age) AS sum_age FROM a GROUP BY 1, 2, 3",
    "split_summary": "SELECT CASE WHEN ldate < DATE '2024-01-01' THEN 'train_core' WHEN ldate < DATE '2025-01-01' THEN 'screen_2024' WHEN ldate < DATE '2026-01-01' THEN 'select_2025' ELSE 'holdout_2026' END AS split, count(*) AS n_rows, count(DISTINCT odino) AS cases, min(ldate)::DATE AS first_date, max(ldate)::DATE AS last_date, count(DISTINCT severity_primary_flag) AS targets FROM odi_severity_cases WHERE ldate IS NOT NULL GROUP BY 1",
    "quality_checks": _quality(),
    "duplicate_rows": "SELECT CAST((SELECT count(*) FROM complaints) - (SELECT count(*) FROM (SELECT DISTINCT * FROM complaints)) AS BIGINT) AS duplicate_rows, (SELECT count(*) FROM complaints) AS n_rows",
    "column_audit": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_share, count(DISTINCT {c}) AS distinct_values, round(count(*) FILTER (regexp_matches(trim({c}), '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?[dDfF]?$')) / greatest(count({c}), 1), 6) AS numeric_share FROM complaints" for c in _AUDIT),
    "outlier_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, q1, q3, p99, q3 + 1.5 * (q3 - q1) AS upper_fence, (SELECT count(*) FROM odi_severity_cases WHERE {c} > q3 + 1.5 * (q3 - q1)) AS above_fence FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.99) AS p99 FROM odi_severity_cases)" for c in _OUT),
    "null_rates": " UNION ALL ".join(f"SELECT prod_type, count(*) AS n_rows, '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 6) AS null_share FROM complaints GROUP BY prod_type" for c in ("miles", "state", "crash", "vin")),
    "lag_bands": "SELECT CASE WHEN lag_days_safe IS NULL THEN 'none' WHEN lag_days_safe = 0 THEN 'same day' WHEN lag_days_safe <= 7 THEN 'week' WHEN lag_days_safe <= 30 THEN 'month' WHEN lag_days_safe <= 90 THEN 'quarter' WHEN lag_days_safe <= 365 THEN 'year' WHEN lag_days_safe <= 1825 THEN 'five years' ELSE 'longer' END AS band, count(*) AS n_rows, quantile_cont(lag_days_safe, 0.95) AS p95 FROM odi_severity_cases GROUP BY 1",
    "month_mix": _CLEAN + "SELECT date_trunc('month', ldate)::DATE AS month, " + ", ".join(f"count(*) FILTER (prod_type = '{p}') AS \"{p}\"" for p in "CETV") + " FROM clean WHERE ldate IS NOT NULL GROUP BY 1",
    "yearly_rates": "SELECT year(ldate) AS yr, count(*) AS n_rows, round(avg(severity_primary_flag::INT), 6) AS primary_rate, round(avg(miles_missing_flag::INT), 6) AS miles_missing_rate FROM odi_severity_cases GROUP BY 1",
    "cohort_growth": _SERIES + f"SELECT month, {_KEYS}, complaints, unique_states, round(ra, 6) AS rolling_6mo_avg, round(gv, 6) AS growth_vs_6mo_avg, round(gd, 6) AS growth_delta_6mo, nw AS new_or_reemerging_signal, emerging AS emerging_signal_flag, round(score, 6) AS watchlist_score FROM series",
    "emerging_watchlist": _COARSE + f"SELECT month, mfr_name, maketxt, modeltxt, yt AS yeartxt, component_group, topic_id, complaints, round(score, 6) AS watchlist_score, signal_tier, concat_ws('; ', CASE WHEN nw THEN 'new/reemerging signal: ' || complaints || ' complaints after zero prior 6-mo baseline' ELSE printf('%.1f', round_even(gv, 1)) || 'x 6-mo baseline' END, {_RISK_TEXT}) AS watchlist_reason FROM watch",
    "risk_monitor": _COARSE + f"SELECT month, maketxt, modeltxt, coalesce(yeartxt::VARCHAR, 'Unknown') AS yeartxt, component_group, topic_id, complaints, round(score, 6) AS watchlist_score, coalesce(nullif(concat_ws('; ', {_RISK_TEXT}), ''), 'persistent risk context') AS monitor_reason FROM sm WHERE watchlist_group = 'defect_watchlist' AND complaints >= 3 AND NOT emerging AND (broad >= 0.35 OR crit >= 0.25)",
    "recurring_signals": _COARSE + "SELECT maketxt, modeltxt, yt AS yeartxt, component_group, topic_id, topic_label, coalesce(string_agg(DISTINCT nullif(mfr_name, ''), ' | ' ORDER BY nullif(mfr_name, '')), '') AS mfr_name, count(DISTINCT month) AS months_flagged, min(month) AS first_month, max(month) AS latest_month, max(complaints) AS max_complaints, round_even(avg(complaints), 2) AS avg_complaints, round_even(median(complaints), 2) AS median_complaints, round_even(max(gv), 2) AS max_growth_vs_6mo_avg, round_even(avg(strength), 3) AS avg_topic_strength, round_even(max(score), 3) AS max_watchlist_score, count(*) FILTER (signal_tier = 'High-confidence signal') AS high_confidence_months, count(*) FILTER (signal_tier IN ('Moderate signal', 'High-confidence signal')) AS moderate_or_higher_months, CASE max(CASE signal_tier WHEN 'High-confidence signal' THEN 3 WHEN 'Moderate signal' THEN 2 ELSE 1 END) WHEN 3 THEN 'High-confidence signal' WHEN 2 THEN 'Moderate signal' ELSE 'Early signal' END AS best_signal_tier FROM watch GROUP BY 1, 2, 3, 4, 5, 6",
    "global_topic_month": _TOPIC + ", mo AS (SELECT topic_id, month, count(DISTINCT odino) AS complaints FROM tr GROUP BY ALL), gr AS (SELECT topic_id, unnest(generate_series(min(month), (SELECT max(month) FROM mo), INTERVAL 1 MONTH))::DATE AS month FROM mo GROUP BY topic_id), se AS (SELECT gr.topic_id, gr.month, coalesce(complaints, 0) AS complaints FROM gr LEFT JOIN mo ON gr.topic_id = mo.topic_id AND gr.month = mo.month), w AS (SELECT *, CASE WHEN count(*) OVER d >= 3 THEN avg(complaints) OVER d END AS ra FROM se WINDOW d AS (PARTITION BY topic_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) SELECT topic_id, month, complaints, round(CASE WHEN ra IS NOT NULL THEN complaints / greatest(ra, 1) END, 6) AS growth_vs_6mo_avg FROM w",
    "signal_flow": _COARSE + "SELECT month, 0 AS monitor, count(*) FILTER (signal_tier = 'Early signal') AS early_signal, count(*) FILTER (signal_tier = 'Moderate signal') AS moderate_signal, count(*) FILTER (signal_tier = 'High-confidence signal') AS high_confidence_signal FROM watch GROUP BY month",
    "review_budgets": _SCORES + ", k AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY score DESC, odino) AS r, count(*) OVER (PARTITION BY yr) AS n, count(*) FILTER (truth) OVER (PARTITION BY yr) AS p FROM s), b AS (SELECT k.*, f.f, greatest(ceil(round(n * f.f, 9)), 1) AS m FROM k, (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE]) AS f) f) SELECT yr, f AS budget_fraction, max(m) AS flagged_rows, round(max(m) / max(n), 6) AS flagged_share, count(*) FILTER (truth) AS captured, round(count(*) FILTER (truth) / nullif(max(p), 0), 6) AS recall_within_flagged_set, round(count(*) FILTER (truth) / max(m), 6) AS precision_within_flagged_set, round(count(*) FILTER (truth) / max(m) / nullif(max(p) / max(n), 0), 6) AS lift_vs_base_rate, min(score) AS score_cutoff FROM b WHERE r <= m GROUP BY yr, f",
    "average_precision": _RANKED + "SELECT yr, round(CASE WHEN max(tp) = 0 OR max(tp) = max(tn) THEN max(tp) / max(tn) ELSE sum(p / nullif(tp, 0) * ((ap + p) / (an + n))) END, 9) AS pr_auc FROM r GROUP BY yr",
    "roc_auc": _RANKED + "SELECT yr, round(CASE WHEN max(tp) * (max(tn) - max(tp)) > 0 THEN sum(p * ((tn - tp) - (an - ap) - (n - p) + 0.5 * (n - p))) / (max(tp) * (max(tn) - max(tp))) END, 9) AS roc_auc FROM r GROUP BY yr",
    "score_summary": _SCORES + ", c AS (SELECT yr, count(*) AS n_rows, count(*) FILTER (score >= 0.5 AND truth) AS tp, count(*) FILTER (score >= 0.5 AND NOT truth) AS fp, count(*) FILTER (score < 0.5 AND truth) AS fn, round(avg(pow(score - truth::INT, 2)), 9) AS brier_score FROM s GROUP BY yr) SELECT yr, n_rows, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, brier_score FROM c",
    "reliability": _SCORES + ", e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM s), b AS (SELECT score, truth, len(list_filter(q[2:len(q) - 1], lambda x: x < score)) + 1 AS bin FROM s, e) SELECT bin, count(*) AS n_rows, round(avg(score), 6) AS avg_score, round(avg(truth::INT), 6) AS observed_rate, round(avg(truth::INT) - avg(score), 6) AS score_gap FROM b GROUP BY bin",
    "calibration": _SCORES + ", b AS (SELECT len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda x: x < score)) + 1 AS bin, truth, score FROM s), g AS (SELECT bin, count(*) AS n, avg(truth::INT) AS a, avg(score) AS c FROM b GROUP BY bin), d AS (SELECT i AS bin, coalesce(n, 0) AS n, a, c FROM generate_series(1, 10) t(i) LEFT JOIN g ON g.bin = i) SELECT bin, n AS n_rows, round(n / sum(n) OVER (), 6) AS share, round(a, 6) AS accuracy, round(c, 6) AS avg_confidence, round(a - c, 6) AS gap, round(sum(n * abs(coalesce(a - c, 0))) OVER () / sum(n) OVER (), 9) AS ece FROM d",
    "class_report": _LABELS + ", x AS (SELECT truth AS c, 1 AS t, 0 AS p, 0 AS h FROM z UNION ALL SELECT predicted, 0, 1, (truth = predicted)::INT FROM z) SELECT c AS class_name, sum(t) AS support, round(coalesce(sum(h) / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(h) / nullif(sum(t), 0), 0), 6) AS recall, round(2 * sum(h) / (sum(t) + sum(p)), 6) AS f1 FROM x GROUP BY c",
    "confusion": _LABELS + ", f AS (SELECT CASE WHEN truth IN ('AIR BAGS', 'ELECTRICAL SYSTEM', 'ENGINE / COOLING', 'STEERING', 'SUSPENSION') THEN truth END AS true_group, predicted AS pred_group, count(*) AS n FROM z WHERE predicted IN ('AIR BAGS', 'ELECTRICAL SYSTEM', 'ENGINE / COOLING', 'STEERING', 'SUSPENSION') GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY true_group), 6) AS row_share FROM f",
    "multilabel_metrics": _LABELS + ", g AS (SELECT list_distinct(labels) AS t, list_distinct([truth, predicted]) AS p FROM z), x AS (SELECT unnest(t) AS c, 1 AS t, 0 AS p, list_contains(p, unnest(t))::INT AS h FROM g), x2 AS (SELECT c, 1 AS t, 0 AS p, list_contains(pp, c)::INT AS h FROM (SELECT unnest(t) AS c, p AS pp FROM g) UNION ALL SELECT unnest(p), 0, 1, 0 FROM g), cl AS (SELECT c, 2 * sum(h) / (sum(t) + sum(p)) AS f1 FROM x2 GROUP BY c) SELECT round(2 * sum(len(list_intersect(t, p))) / (sum(len(t)) + sum(len(p))), 6) AS micro_f1, (SELECT round(avg(f1), 6) FROM cl) AS macro_f1, round(avg((list_sort(t) = list_sort(p))::INT), 6) AS exact_match, (SELECT count(*) FROM cl) AS label_coverage FROM g",
    "label_prevalence": _LABELS + "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM z), 6) AS prevalence FROM (SELECT unnest(list_distinct(labels)) AS label FROM z) GROUP BY label",
    "text_features": f"SELECT odino, list_max(list_transform(regexp_extract_all(cdescr, '{X.SPEED}', 1), lambda x: try_cast(x AS INTEGER))) AS max_mph, coalesce(regexp_matches(cdescr, '{compact(X.HIGHWAY)}'), false) AS highway_flag, coalesce(trim(cdescr) <> '' AND (upper(trim(cdescr)) IN ({_list(C.PLACEHOLDERS)}) OR (length(trim(cdescr)) <= 10 AND NOT regexp_matches(upper(trim(cdescr)), '[A-Z]'))), false) AS placeholder_flag FROM odi_severity_cases",
    "personal_strip": "SELECT DISTINCT cmplid, md5(" + "regexp_replace(" * len(X.PERSONAL) + "cdescr" + "".join(f", '{p}', ' ', 'g')" for p in X.PERSONAL) + ") AS text_md5 FROM complaints",
    "tfidf_terms": """WITH d AS (SELECT odino, regexp_extract_all(lower(cdescr), '[a-z0-9_]{2,}') AS w FROM odi_severity_cases WHERE cdescr IS NOT NULL), tf AS (SELECT odino, term, count(*) AS tf FROM (SELECT odino, unnest(w) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.75 * (SELECT count(*) FROM d)), w AS (SELECT odino, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term),
nm AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY odino)) AS u FROM w) SELECT term, count(*) AS docs, round(sum(u), 5) AS total_weight FROM nm GROUP BY term""",
}
SQL["multilabel_metrics"] = SQL["multilabel_metrics"].replace(", x AS (SELECT unnest(t) AS c, 1 AS t, 0 AS p, list_contains(p, unnest(t))::INT AS h FROM g)", "")

_MAKES = _TOPIC.replace("maketxt, modeltxt, yeartxt, state,", "maketxt, state,", 1)
SQL |= {
    "topic_mix": _MAKES + "SELECT topic_id, sum(n)::BIGINT AS complaints, count(*) AS cohorts FROM (SELECT topic_id, maketxt, count(DISTINCT odino) AS n FROM tr WHERE month = (SELECT max(month) FROM tr) GROUP BY ALL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "leaderboard": _MAKES + "SELECT month, maketxt, component_group, count(DISTINCT odino) AS complaints, count(DISTINCT odino) + count(DISTINCT state) AS score FROM tr WHERE month = (SELECT max(month) FROM tr) GROUP BY ALL ORDER BY score DESC, complaints DESC, maketxt NULLS LAST, component_group LIMIT 12",
    "label_shares": _LABELS + ", c AS (SELECT truth, count(*) AS n_rows FROM z GROUP BY 1) SELECT truth, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share, round(sum(n_rows) OVER (ORDER BY n_rows DESC, truth ROWS UNBOUNDED PRECEDING) / sum(n_rows) OVER (), 6) AS cumulative_share FROM c",
    "share_shift": "WITH b AS (SELECT state, count(*) / sum(count(*)) OVER () AS s FROM odi_severity_cases WHERE state IS NOT NULL AND ldate < DATE '2024-01-01' GROUP BY 1), a AS (SELECT state, count(*) / sum(count(*)) OVER () AS s FROM odi_severity_cases WHERE state IS NOT NULL AND ldate >= DATE '2024-01-01' GROUP BY 1) SELECT coalesce(b.state, a.state) AS state, round(coalesce(b.s, 0), 6) AS before_share, round(coalesce(a.s, 0), 6) AS after_share, round(100 * (coalesce(a.s, 0) - b.s) / b.s, 6) AS share_percent_change FROM b FULL JOIN a ON a.state = b.state",
    "urgency_bands": _SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY score DESC, odino) / count(*) OVER (PARTITION BY yr) AS pr FROM s) SELECT yr, CASE WHEN pr <= 0.01 THEN 'critical' WHEN pr <= 0.05 THEN 'high' WHEN pr <= 0.10 THEN 'elevated' ELSE 'routine' END AS band, count(*) AS n_rows, count(*) FILTER (truth) AS severe, round(max(pr), 6) AS last_place FROM r GROUP BY 1, 2",
    "threshold_grid": _LABELS + ", g AS (SELECT row_number() OVER () AS i, truth, list_distinct(labels) AS l FROM z), t AS (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE]) AS threshold), p AS (SELECT threshold, i, truth, list_filter(l, lambda x: length(x) / 40::DOUBLE >= threshold) AS guess FROM g, t), x AS (SELECT threshold, truth AS c, 1 AS t, 0 AS p, list_contains(guess, truth)::INT AS h FROM p UNION ALL SELECT threshold, unnest(guess), 0, 1, 0 FROM p), k AS (SELECT threshold, c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM x GROUP BY 1, 2) SELECT threshold, round(2 * sum(h) / (sum(t) + sum(p)), 6) AS micro_f1, round(avg(2 * h / (t + p)), 6) AS macro_f1 FROM k GROUP BY 1",
    "latest_case_per_make": "SELECT maketxt, odino, ldate::DATE AS ldate FROM odi_severity_cases WHERE ldate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY maketxt ORDER BY ldate DESC, odino) = 1",
    "set_operations": "WITH b AS (SELECT modeltxt FROM odi_severity_cases WHERE modeltxt IS NOT NULL AND ldate < DATE '2024-01-01'), s AS (SELECT modeltxt FROM odi_severity_cases WHERE modeltxt IS NOT NULL AND ldate >= DATE '2024-01-01') SELECT 'before' AS part, modeltxt FROM (SELECT * FROM b EXCEPT SELECT * FROM s) UNION ALL SELECT 'since', modeltxt FROM (SELECT * FROM s EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', modeltxt FROM (SELECT * FROM b INTERSECT SELECT * FROM s)",
    "event_properties": "SELECT event_type, ts::DATE AS day, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS sum_k, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
}
#: Date columns leave as ISO text.
for _name, _columns in {
    "clean_rows": ("ldate", "faildate"), "multi_cases": ("ldate",), "best_texts": ("ldate",), "text_conflicts": ("first_date", "last_date"), "split_summary": ("first_date", "last_date"), "month_mix": ("month",),
    "cohort_growth": ("month",), "emerging_watchlist": ("month",), "risk_monitor": ("month",), "recurring_signals": ("first_month", "latest_month"), "global_topic_month": ("month",), "signal_flow": ("month",), "watchlist_summary": ("month",),
    "leaderboard": ("month",), "latest_case_per_make": ("ldate",), "event_properties": ("day",),
}.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _columns)}) FROM ({SQL[_name]}) AS dated"

# the same questions over the whole cohort: make, model, year, component and topic
SQL |= {f"{n}_full": SQL[n].replace(_COARSE, _SERIES) for n in ("emerging_watchlist", "risk_monitor", "recurring_signals", "signal_flow")}
