"""DuckDB SQL for every query of the catalog, over the same tables."""

from __future__ import annotations

import re

_CRASHES = """crashes AS (SELECT
  cast(o_orderkey as varchar) AS CRASH_RECORD_ID,
  case when o_orderkey % 97 = 0 then 'not a date' when o_orderkey % 89 = 0 then null
    else strftime(o_orderdate + to_minutes(cast(o_orderkey * 37 % 1440 as bigint)),
      '%m/%d/%Y %I:%M:%S %p') end AS CRASH_DATE,
  case when o_orderkey % 53 = 0 then null when o_orderkey % 59 = 0 then '0.0'
    else cast(cast(41.65 as double) + cast((o_orderkey % 40) * 10 as double) / 1000 as varchar)
    end AS LATITUDE,
  case when o_orderkey % 53 = 0 then null when o_orderkey % 61 = 0 then '0.0'
    else cast(cast(-87.9 as double) + cast((o_custkey % 20) * 20 as double) / 1000 as varchar)
    end AS LONGITUDE,
  case when o_orderkey % 41 = 0 then ' nan ' when o_orderkey % 43 = 0 then null
    else concat(' ', lower(o_orderpriority), ' ', cast(o_custkey % 6 as varchar), ' ')
    end AS PRIM_CONTRIBUTORY_CAUSE,
  case when o_orderkey % 47 = 0 then 'None'
    else concat(o_orderstatus, cast(o_custkey % 5 as varchar)) end AS WEATHER_CONDITION,
  concat('light ', cast(o_custkey % 11 as varchar)) AS LIGHTING_CONDITION,
  concat('tcd ', cast(o_custkey % 4 as varchar)) AS TRAFFIC_CONTROL_DEVICE,
  concat('surface ', cast(o_custkey % 13 as varchar)) AS ROADWAY_SURFACE_COND,
  case when o_orderkey % 103 = 0 then null when o_orderkey % 101 = 0 then '1' else '0' end
    AS INJURIES_FATAL,
  case when o_orderkey % 17 = 0 then '1' else '0' end AS INJURIES_INCAPACITATING,
  case when o_orderkey % 5 = 0 then '2' else '0' end AS INJURIES_NON_INCAPACITATING,
  case when o_orderkey % 107 = 0 then 'nan' when o_orderkey % 109 = 0 then 'Infinity'
    when o_orderkey % 7 = 0 then '1' else '0' end AS INJURIES_POSSIBLE
  FROM orders)"""

_PEOPLE = """people AS (SELECT
  concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-',
    cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) AS PERSON_ID,
  cast(l_orderkey as varchar) AS CRASH_RECORD_ID,
  case when l_returnflag = 'N' then null else cast(l_orderkey * 10 + l_linenumber as varchar) end
    AS VEHICLE_ID,
  case l_linenumber % 5 when 0 then 'PASSENGER' when 1 then 'DRIVER' when 2 then ' driver '
    when 3 then 'PEDESTRIAN' else 'BICYCLE' end AS PERSON_TYPE,
  case when l_partkey % 19 = 0 then null when l_partkey % 37 = 0 then 'nan'
    else cast(l_partkey % 95 as varchar) end AS AGE,
  case when l_suppkey % 23 = 0 then null else concat(' st', cast(l_suppkey % 13 as varchar)) end
    AS DRIVER_LICENSE_STATE
  FROM lineitem)"""

_VEHICLES = """vehicles AS (SELECT
  cast(l_orderkey * 10 + l_linenumber as varchar) AS VEHICLE_ID,
  cast(l_orderkey as varchar) AS CRASH_RECORD_ID,
  min(p_brand) AS VEHICLE_TYPE,
  case when min(l_quantity) > 45 then 'SPEED TOO FAST' else 'OTHER' end AS PRIM_CONTRIBUTORY_CAUSE
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber)"""

_FATALITIES = """fatalities AS (SELECT cast(o_orderkey as varchar) AS CRASH_RECORD_ID
  FROM orders WHERE o_orderkey % 101 = 0)"""

# Parsed dates and coordinates as they come in.
_PARSED = """parsed AS (SELECT * REPLACE (
    case when upper(trim(PRIM_CONTRIBUTORY_CAUSE)) in ('NAN', 'NONE') then null
      else upper(trim(PRIM_CONTRIBUTORY_CAUSE)) end AS PRIM_CONTRIBUTORY_CAUSE,
    case when upper(trim(WEATHER_CONDITION)) in ('NAN', 'NONE') then null
      else upper(trim(WEATHER_CONDITION)) end AS WEATHER_CONDITION,
    case when upper(trim(LIGHTING_CONDITION)) in ('NAN', 'NONE') then null
      else upper(trim(LIGHTING_CONDITION)) end AS LIGHTING_CONDITION,
    case when upper(trim(TRAFFIC_CONTROL_DEVICE)) in ('NAN', 'NONE') then null
      else upper(trim(TRAFFIC_CONTROL_DEVICE)) end AS TRAFFIC_CONTROL_DEVICE),
  coalesce(try_strptime(CRASH_DATE, '%m/%d/%Y %I:%M:%S %p'), try_cast(CRASH_DATE as timestamp))
    AS CRASH_DATETIME,
  try_cast(LATITUDE as double) AS lat0, try_cast(LONGITUDE as double) AS lon0,
  crashes.PRIM_CONTRIBUTORY_CAUSE AS raw_cause
  FROM crashes)"""

# Cleaned crashes with flags, impact and grid cell.
_CLEAN = """clean AS (SELECT * EXCLUDE (lat0, lon0, raw_cause),
  cast(year(CRASH_DATETIME) as integer) AS YEAR, cast(month(CRASH_DATETIME) as integer) AS MONTH,
  cast(dayofweek(CRASH_DATETIME) + 1 as integer) AS DAY_OF_WEEK_NUM,
  cast(hour(CRASH_DATETIME) as integer) AS HOUR,
  case when not (lat0 between 41.60 and 42.10 and lon0 between -88.0 and -87.3) then null
    else lat0 end AS LAT,
  case when not (lat0 between 41.60 and 42.10 and lon0 between -88.0 and -87.3) then null
    else lon0 end AS LON
  FROM parsed),
flagged AS (SELECT *,
  (try_cast(INJURIES_FATAL as double) > 0 or try_cast(INJURIES_INCAPACITATING as double) > 0
    or try_cast(INJURIES_NON_INCAPACITATING as double) > 0
    or try_cast(INJURIES_POSSIBLE as double) > 0) AS injury_any,
  coalesce(try_cast(INJURIES_FATAL as double) > 0, false) AS is_fatal,
  try_cast(INJURIES_FATAL as double) AS inj_fatal,
  try_cast(INJURIES_INCAPACITATING as double) AS inj_sev,
  try_cast(INJURIES_NON_INCAPACITATING as double) AS inj_nonsev,
  try_cast(INJURIES_POSSIBLE as double) AS inj_possible,
  try_cast(INJURIES_FATAL as double) * 10 + try_cast(INJURIES_INCAPACITATING as double) * 5
    + try_cast(INJURIES_NON_INCAPACITATING as double) * 2
    + try_cast(INJURIES_POSSIBLE as double) AS impact_score
  FROM clean),
located AS (SELECT *, case when HOUR >= 6 and HOUR <= 19 then 'DAY' else 'NIGHT' end AS period,
  round(LAT, 3) AS lat_bin, round(LON, 3) AS lon_bin
  FROM flagged WHERE LAT is not null and LON is not null)"""

# Driver grain: drivers, their vehicle and their crash.
_DRIVERS = """driver_rows AS (SELECT p.PERSON_ID, p.CRASH_RECORD_ID, p.VEHICLE_ID, v.VEHICLE_TYPE,
  c.CRASH_DATE, c.CRASH_DATETIME, c.lat0 AS LAT, c.lon0 AS LON,
  coalesce(try_cast(c.INJURIES_FATAL as double) > 0, false) AS fatal_outcome,
  case when try_cast(AGE as double) < 16 then '<16'
    when try_cast(AGE as double) between 16 and 24 then '16-24'
    when try_cast(AGE as double) between 25 and 34 then '25-34'
    when try_cast(AGE as double) between 35 and 49 then '35-49'
    when try_cast(AGE as double) between 50 and 64 then '50-64'
    when try_cast(AGE as double) >= 65 then '65+' else 'UNKNOWN' end AS age_bin,
  upper(trim(p.DRIVER_LICENSE_STATE)) AS license_state,
  upper(trim(c.ROADWAY_SURFACE_COND)) AS surface,
  c.raw_cause AS PRIM_CONTRIBUTORY_CAUSE
  FROM people p
  LEFT JOIN vehicles v ON p.CRASH_RECORD_ID = v.CRASH_RECORD_ID AND p.VEHICLE_ID = v.VEHICLE_ID
  LEFT JOIN parsed c ON p.CRASH_RECORD_ID = c.CRASH_RECORD_ID
  WHERE upper(trim(p.PERSON_TYPE)) = 'DRIVER')"""

_CRASH = ",\n".join([_CRASHES, _PARSED, _CLEAN])
_DRIVER = ",\n".join([_CRASHES, _PARSED, _PEOPLE, _VEHICLES, _DRIVERS])

_CELLS = """counts AS (SELECT lat_bin, lon_bin, PRIM_CONTRIBUTORY_CAUSE AS cause, count(*) AS n
  FROM located GROUP BY ALL),
top AS (SELECT lat_bin, lon_bin, cause AS top_cause FROM counts
  QUALIFY row_number() OVER (PARTITION BY lat_bin, lon_bin ORDER BY n DESC, cause ASC NULLS LAST) = 1),
cells AS (SELECT lat_bin, lon_bin, count(LAT) AS count,
  count(case when injury_any then 1 end) AS injury_any_count,
  count(case when is_fatal then 1 end) AS fatal_count,
  cast(count(case when injury_any then 1 end) as double) / count(LAT) AS injury_rate,
  count(case when is_fatal then 1 end) > 0 AS fatal_flag, lat_bin AS lat, lon_bin AS lon
  FROM located GROUP BY lat_bin, lon_bin),
ranked AS (SELECT cells.*, top.top_cause FROM cells JOIN top USING (lat_bin, lon_bin)
  ORDER BY count DESC, fatal_count DESC, injury_rate DESC, lat_bin, lon_bin LIMIT 200)"""

_CAUSES = """causes AS (SELECT PRIM_CONTRIBUTORY_CAUSE, count(LAT) AS crashes,
  sum(impact_score) AS total_impact, sum(inj_fatal) AS fatalities, sum(inj_sev) AS severe_injuries,
  sum(inj_nonsev) AS nonsevere_injuries, sum(inj_possible) AS possible_injuries
  FROM flagged GROUP BY 1),
top5 AS (SELECT PRIM_CONTRIBUTORY_CAUSE AS cause, crashes, total_impact, fatalities,
  severe_injuries, nonsevere_injuries, possible_injuries FROM causes
  ORDER BY total_impact DESC NULLS LAST, fatalities DESC NULLS LAST, crashes DESC NULLS LAST,
    PRIM_CONTRIBUTORY_CAUSE ASC NULLS LAST LIMIT 5)"""


def _hash(*columns: str) -> str:
    """The sampling order: hash of the columns' texts and the seed."""
    text = [f"coalesce(cast({c} as varchar), '')" for c in columns]
    return f"md5(concat_ws('|', {', '.join(text)}, '0'))"


def _with(ctes: str, select: str) -> str:
    """The query; text is a number only if it is a finite one."""
    text = f"WITH {ctes}\n{select}"
    number = r"try_cast\((\w+(?:\.\w+)?) as double\)"
    return re.sub(number, r"(case when isfinite(\g<0>) then \g<0> end)", text)


def _topk_rate(ctes: str, source: str, column: str, k: int, fatal: str) -> str:
    return _with(
        ctes,
        f"""SELECT {column}, fatal_rate FROM (
  SELECT {column}, count(*) AS n,
    cast(count(case when {fatal} then 1 end) as double) / count(*) AS fatal_rate
  FROM {source} GROUP BY {column} ORDER BY n DESC, {column} ASC NULLS LAST LIMIT {k})
WHERE {column} IS NOT NULL""",
    )


def _popup(c: str) -> str:
    return f"coalesce(cast({c} as varchar), 'None')"


_PROFILED = (
    "CRASH_RECORD_ID CRASH_DATE LATITUDE LONGITUDE PRIM_CONTRIBUTORY_CAUSE WEATHER_CONDITION"
    " LIGHTING_CONDITION TRAFFIC_CONTROL_DEVICE ROADWAY_SURFACE_COND INJURIES_FATAL"
    " INJURIES_INCAPACITATING INJURIES_NON_INCAPACITATING INJURIES_POSSIBLE CRASH_DATETIME"
    " YEAR MONTH DAY_OF_WEEK_NUM HOUR LAT LON"
).split()

_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_AGES = ("<16", "16-24", "25-34", "35-49", "50-64", "65+")
_SURFACE_RATE = """SELECT surface,
  cast(count(case when fatal_outcome then 1 end) as double) / count(*) AS fatal_rate
  FROM driver_rows GROUP BY surface ORDER BY fatal_rate DESC, surface ASC NULLS LAST"""


def _values(values: tuple[str, ...]) -> str:
    return ", ".join(f"('{v}')" for v in values)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["daily_counts"] = _with(
        _CRASH,
        """SELECT cast(CRASH_DATETIME as date) AS CRASH_DATE, count(*) AS count
FROM clean WHERE CRASH_DATETIME IS NOT NULL GROUP BY 1""",
    )
    sql["monthly_counts"] = _with(
        _CRASH,
        """SELECT cast(date_trunc('month', CRASH_DATETIME) as timestamp) AS CRASH_MONTH,
  count(*) AS count FROM clean WHERE CRASH_DATETIME IS NOT NULL GROUP BY 1""",
    )
    sql["rolling7_daily"] = _with(
        _CRASH,
        """SELECT CRASH_DATE, count,
  case when count(*) OVER w = 7 then avg(count) OVER w end AS rolling7
FROM (SELECT cast(CRASH_DATETIME as date) AS CRASH_DATE, count(*) AS count
  FROM clean WHERE CRASH_DATETIME IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY CRASH_DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    )
    sql["hour_counts"] = _with(
        _CRASH, "SELECT HOUR, count(*) AS count FROM clean WHERE HOUR IS NOT NULL GROUP BY HOUR"
    )
    sql["dow_counts"] = _with(
        _CRASH,
        f"""SELECT d.DAY_OF_WEEK, count(c.CRASH_DATETIME) AS count
FROM (VALUES {_values(_DAYS)}) d(DAY_OF_WEEK)
LEFT JOIN clean c ON dayname(c.CRASH_DATETIME) = d.DAY_OF_WEEK GROUP BY 1""",
    )
    sql["date_parts"] = _with(
        _CRASH,
        """SELECT CRASH_RECORD_ID, YEAR, MONTH, DAY_OF_WEEK_NUM, HOUR,
  coalesce(dayname(CRASH_DATETIME), 'Unknown') AS DAY_OF_WEEK FROM clean""",
    )
    sql["hour_year_from_text"] = _with(
        _CRASHES,
        r"""SELECT CRASH_RECORD_ID,
  case when h is null then null when half = 'AM' then case when h = 12 then 0 else h end
    when half = 'PM' then case when h = 12 then 12 else h + 12 end else h end AS HOUR,
  try_cast(nullif(regexp_extract(CRASH_DATE, '(\d{4})', 1), '') as integer) AS YEAR
FROM (SELECT *,
  try_cast(nullif(regexp_extract(CRASH_DATE, '(\d{1,2}):\d{2}:\d{2}\s*([AP]M)?', 1), '') as integer) AS h,
  regexp_extract(CRASH_DATE, '(\d{1,2}):\d{2}:\d{2}\s*([AP]M)?', 2) AS half FROM crashes)""",
    )
    sql["geo_clean"] = _with(_CRASH, "SELECT CRASH_RECORD_ID, LAT, LON FROM clean")
    sql["clean_categories"] = _with(
        _CRASH,
        """SELECT CRASH_RECORD_ID, PRIM_CONTRIBUTORY_CAUSE, WEATHER_CONDITION, LIGHTING_CONDITION,
  TRAFFIC_CONTROL_DEVICE FROM clean""",
    )
    people_sum = """SELECT CRASH_RECORD_ID, count(PERSON_ID) AS persons,
  cast(sum(case when PERSON_TYPE = 'PEDESTRIAN' then 1 else 0 end) as bigint) AS pedestrians,
  cast(sum(case when PERSON_TYPE = 'BICYCLE' then 1 else 0 end) as bigint) AS cyclists
  FROM people GROUP BY 1"""
    vehicles_sum = """SELECT CRASH_RECORD_ID, count(VEHICLE_ID) AS vehicles,
  cast(sum(case when PRIM_CONTRIBUTORY_CAUSE like '%SPEED%' then 1 else 0 end) as bigint)
    AS speeding_veh FROM vehicles GROUP BY 1"""
    sql["people_summary"] = _with(_PEOPLE, people_sum)
    sql["vehicles_summary"] = _with(_VEHICLES, vehicles_sum)
    merged = ",\n".join(
        [_CRASH, _PEOPLE, _VEHICLES, f"ps AS ({people_sum})", f"vs AS ({vehicles_sum})"]
    )
    sql["crash_combined"] = _with(
        merged,
        """SELECT CRASH_RECORD_ID, PRIM_CONTRIBUTORY_CAUSE, LAT, LON, HOUR, persons, pedestrians,
  cyclists, vehicles, speeding_veh
FROM clean LEFT JOIN ps USING (CRASH_RECORD_ID) LEFT JOIN vs USING (CRASH_RECORD_ID)""",
    )
    sql["injury_flags"] = _with(_CRASH, "SELECT CRASH_RECORD_ID, injury_any, is_fatal FROM flagged")
    sql["injury_share"] = _with(
        _CRASH,
        """SELECT count(*) AS crashes, count(case when injury_any then 1 end) AS injured,
  cast(count(case when injury_any then 1 end) as double) / count(*) AS injury_share FROM flagged""",
    )
    sql["top_causes"] = _with(
        _CRASH,
        """SELECT PRIM_CONTRIBUTORY_CAUSE, count(*) AS count FROM clean GROUP BY 1
ORDER BY count DESC, PRIM_CONTRIBUTORY_CAUSE ASC NULLS LAST LIMIT 12""",
    )
    sql["injury_rate_by_weather"] = _with(
        _CRASH,
        """SELECT WEATHER_CONDITION,
  cast(count(case when injury_any then 1 end) as double) / count(*) AS injury_rate
FROM flagged GROUP BY 1 ORDER BY injury_rate DESC, WEATHER_CONDITION ASC NULLS LAST LIMIT 10""",
    )
    heat = _hash("CRASH_RECORD_ID", "LAT", "LON")
    sql["heat_sample"] = _with(
        _CRASH,
        f"""SELECT CRASH_RECORD_ID, LAT AS lat, LON AS lon FROM located
ORDER BY {heat}, CRASH_RECORD_ID LIMIT 50000""",
    )
    sql["median_center"] = _with(
        _CRASH,
        "SELECT median(LAT) AS lat, median(LON) AS lon FROM located",
    )
    sql["marker_points"] = _with(
        _CRASH,
        f"""SELECT LAT AS lat, LON AS lon,
  concat(CRASH_RECORD_ID, ' | ', cast(CRASH_DATETIME as varchar)) AS popup
FROM located WHERE CRASH_DATETIME IS NOT NULL
ORDER BY {_hash("LAT", "LON", "CRASH_RECORD_ID", "CRASH_DATETIME")} LIMIT 3000""",
    )
    sql["period_counts"] = _with(
        _CRASH, "SELECT period, count(*) AS count FROM located GROUP BY period"
    )
    sql["hotspot_cells"] = _with(f"{_CRASH},\n{_CELLS}", "SELECT * FROM cells")
    sql["cell_top_cause"] = _with(f"{_CRASH},\n{_CELLS}", "SELECT * FROM top")
    sql["hotspots_top200"] = _with(f"{_CRASH},\n{_CELLS}", "SELECT * FROM ranked")
    sql["hotspot_layer"] = _with(
        f"{_CRASH},\n{_CELLS}",
        f"""SELECT 'Hotspots' AS layer, lat, lon,
  cast(greatest(4, least(30, floor(sqrt(count) * 3))) as integer) AS radius,
  case when fatal_count > 0 then '#d73027' else '#1a9850' end AS color,
  concat('Count: ', count, '<br>Injuries: ', injury_any_count, '<br>Fatal: ', fatal_count,
    '<br>Top cause: ', {_popup("top_cause")}) AS popup FROM ranked""",
    )
    sql["period_heat"] = _with(
        _CRASH,
        f"""SELECT period AS layer, CRASH_RECORD_ID, LAT AS lat, LON AS lon FROM located
QUALIFY row_number() OVER (PARTITION BY period ORDER BY {heat}) <= 50000""",
    )
    fatal_hash = _hash("CRASH_RECORD_ID", "LAT", "LON", "CRASH_DATETIME", "PRIM_CONTRIBUTORY_CAUSE")
    sql["fatal_points"] = _with(
        _CRASH,
        f"""SELECT 'Fatalities' AS layer, LAT AS lat, LON AS lon, 4 AS radius, '#000' AS color,
  concat('Fatal crash | ', {_popup("CRASH_DATETIME")}, ' | Cause: ',
    {_popup("PRIM_CONTRIBUTORY_CAUSE")}) AS popup
FROM located WHERE is_fatal ORDER BY {fatal_hash} LIMIT 5000""",
    )
    sql["cause_impact"] = _with(f"{_CRASH},\n{_CAUSES}", "SELECT * FROM causes")
    sql["cause_impact_top5"] = _with(f"{_CRASH},\n{_CAUSES}", "SELECT * FROM top5")
    sql["impact_scores"] = _with(
        _CRASH,
        """SELECT CRASH_RECORD_ID, inj_fatal, inj_sev, inj_nonsev, inj_possible, impact_score
FROM flagged""",
    )
    point_hash = _hash(
        "CRASH_RECORD_ID", "LAT", "LON", "impact_score", "inj_fatal", "inj_sev", "rank"
    )
    sql["top_cause_layers"] = _with(
        f"""{_CRASH},
{_CAUSES},
numbered AS (SELECT cause, row_number() OVER (ORDER BY total_impact DESC NULLS LAST,
  fatalities DESC NULLS LAST, crashes DESC NULLS LAST, cause ASC NULLS LAST) - 1 AS rank FROM top5),
points AS (SELECT l.*, n.rank, {point_hash} AS h
  FROM located l JOIN numbered n ON l.PRIM_CONTRIBUTORY_CAUSE = n.cause
  WHERE impact_score IS NOT NULL AND inj_fatal IS NOT NULL AND inj_sev IS NOT NULL)""",
        """SELECT concat('Cause: ', PRIM_CONTRIBUTORY_CAUSE) AS layer, 'heat' AS kind,
  CRASH_RECORD_ID, LAT AS lat, LON AS lon, 10 AS radius, cast(null as varchar) AS color
FROM (FROM points QUALIFY row_number() OVER (PARTITION BY rank ORDER BY h) <= 50000)
UNION ALL
SELECT concat('Cause: ', PRIM_CONTRIBUTORY_CAUSE), 'circle', CRASH_RECORD_ID, LAT, LON,
  cast(3 + least(6, floor(sqrt(impact_score))) as integer),
  case when inj_fatal = 0 then ['#d7191c', '#fdae61', '#2c7bb6', '#abd9e9', '#1a9641'][rank + 1]
    else '#000000' end
FROM (FROM points QUALIFY row_number() OVER (PARTITION BY rank
  ORDER BY inj_fatal DESC, inj_sev DESC, impact_score DESC, h) <= 2000)""",
    )
    sql["risk_cells"] = _with(
        _CRASH,
        """SELECT lat_bin, lon_bin, count(impact_score) AS crashes, avg(impact_score) AS risk
FROM located GROUP BY lat_bin, lon_bin""",
    )
    sql["drivers_joined"] = _with(
        _DRIVER,
        """SELECT PERSON_ID, CRASH_RECORD_ID, VEHICLE_ID, VEHICLE_TYPE, CRASH_DATE, fatal_outcome
FROM driver_rows""",
    )
    sql["driver_features"] = _with(
        _DRIVER,
        """SELECT CRASH_RECORD_ID, cast(CRASH_DATETIME as varchar) AS CRASH_DATETIME,
  cast(hour(CRASH_DATETIME) as integer) AS HOUR, cast(year(CRASH_DATETIME) as integer) AS YEAR,
  LAT, LON, fatal_outcome, age_bin, license_state, surface, PRIM_CONTRIBUTORY_CAUSE
FROM driver_rows""",
    )
    sql["driver_features_keyed"] = sql["driver_features"]
    sql["fatal_rate_by_age"] = _with(
        _DRIVER,
        f"""SELECT a.age_bin, coalesce(
  cast(count(case when fatal_outcome then 1 end) as double) / nullif(count(d.age_bin), 0), 0.0e0)
  AS fatal_rate
FROM (VALUES {_values(_AGES)}) a(age_bin) LEFT JOIN driver_rows d USING (age_bin) GROUP BY 1""",
    )
    sql["fatal_rate_by_state_top10"] = _topk_rate(
        _DRIVER, "driver_rows", "license_state", 10, "fatal_outcome"
    )
    sql["fatal_rate_by_surface"] = _with(_DRIVER, f"{_SURFACE_RATE} LIMIT 10")
    sql["approx_center"] = _with(
        _DRIVER,
        """SELECT quantile_disc(LAT, 0.5) AS lat, quantile_disc(LON, 0.5) AS lon FROM driver_rows
WHERE fatal_outcome AND LAT IS NOT NULL AND LON IS NOT NULL""",
    )
    sql["fatal_driver_center"] = _with(
        _DRIVER,
        """SELECT median(LAT) AS lat, median(LON) AS lon FROM driver_rows
WHERE fatal_outcome AND LAT IS NOT NULL AND LON IS NOT NULL""",
    )
    sql["fatal_by_age_layers"] = _with(
        _DRIVER,
        f"""SELECT concat('Fatal drivers: Age ', age_bin) AS layer, LAT AS lat, LON AS lon,
  4 AS radius, case age_bin when '<16' then '#984ea3' when '16-24' then '#e41a1c'
    when '25-34' then '#377eb8' when '35-49' then '#4daf4a' when '50-64' then '#ff7f00'
    else '#a65628' end AS color,
  concat('Age ', age_bin, ' | ', {_popup("CRASH_DATETIME")}) AS popup
FROM driver_rows WHERE fatal_outcome AND age_bin <> 'UNKNOWN'
  AND LAT IS NOT NULL AND LON IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY age_bin
  ORDER BY {_hash("LAT", "LON", "CRASH_DATETIME")}) <= 3000""",
    )
    sql["fatal_by_surface_layers"] = _with(
        f"{_DRIVER},\ntop AS ({_SURFACE_RATE} LIMIT 5)",
        f"""SELECT concat('Fatal: Surface ', surface) AS layer, LAT AS lat, LON AS lon
FROM driver_rows WHERE fatal_outcome AND LAT IS NOT NULL AND LON IS NOT NULL
  AND surface IN (SELECT surface FROM top)
QUALIFY row_number() OVER (PARTITION BY surface ORDER BY {_hash("LAT", "LON")}) <= 40000""",
    )
    sql["fatal_people_layers"] = _with(
        f"{_CRASH},\n{_PEOPLE}",
        """SELECT upper(trim(PERSON_TYPE)) AS layer, CRASH_RECORD_ID, LAT AS lat, LON AS lon,
  count(*) AS persons
FROM people JOIN located USING (CRASH_RECORD_ID)
WHERE is_fatal AND upper(trim(PERSON_TYPE)) IN ('BICYCLE', 'PEDESTRIAN') GROUP BY ALL""",
    )
    sql["fatal_ref_flag"] = _with(
        f"{_CRASHES},\n{_FATALITIES}",
        """SELECT CRASH_RECORD_ID,
  CRASH_RECORD_ID IN (SELECT CRASH_RECORD_ID FROM fatalities) AS is_fatal FROM crashes""",
    )
    sql["hourly_fatal"] = _with(
        _CRASH,
        """SELECT HOUR, total, fatal, total - fatal AS nonfatal,
  cast(fatal as double) / total AS fatal_rate, cast(total - fatal as double) / total AS nonfatal_rate
FROM (SELECT HOUR, count(*) AS total, count(case when is_fatal then 1 end) AS fatal
  FROM flagged WHERE HOUR IS NOT NULL GROUP BY HOUR)""",
    )
    sql["topk_rate_lighting"] = _topk_rate(_CRASH, "flagged", "LIGHTING_CONDITION", 8, "is_fatal")
    sql["topk_rate_weather"] = _topk_rate(_CRASH, "flagged", "WEATHER_CONDITION", 8, "is_fatal")
    surfaces = f"{_CRASH},\nsurfaces AS (SELECT * REPLACE (upper(trim(ROADWAY_SURFACE_COND)) AS ROADWAY_SURFACE_COND) FROM flagged)"
    sql["topk_rate_surface"] = _topk_rate(surfaces, "surfaces", "ROADWAY_SURFACE_COND", 8, "is_fatal")
    modes = """modes AS (SELECT CRASH_RECORD_ID, VEHICLE_TYPE AS VEHICLE_TYPE_MODE FROM (
  SELECT CRASH_RECORD_ID, VEHICLE_TYPE, count(*) AS n FROM vehicles GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY CRASH_RECORD_ID
    ORDER BY n DESC, VEHICLE_TYPE ASC NULLS LAST) = 1)"""
    sql["vehicle_mode"] = _with(f"{_VEHICLES},\n{modes}", "SELECT * FROM modes")
    with_modes = (
        f"{_CRASH},\n{_VEHICLES},\n{modes},\n"
        "typed AS (SELECT * FROM flagged LEFT JOIN modes USING (CRASH_RECORD_ID))"
    )
    sql["fatal_rate_by_vehicle_mode"] = _topk_rate(
        with_modes, "typed", "VEHICLE_TYPE_MODE", 8, "is_fatal"
    )
    sql["fatal_vehicle_type_layer"] = _with(
        f"{_CRASH},\n{_VEHICLES},\n{modes}",
        """SELECT CRASH_RECORD_ID, LAT AS lat, LON AS lon, VEHICLE_TYPE_MODE AS vehicle_type
FROM located JOIN modes USING (CRASH_RECORD_ID)
WHERE is_fatal AND VEHICLE_TYPE_MODE IN ('Brand#11', 'Brand#22', 'Brand#33')""",
    )
    sql["fatal_hit_run_layer"] = _with(
        f"{_CRASH},\n{_VEHICLES},\n{modes}",
        """SELECT CRASH_RECORD_ID, LAT AS lat, LON AS lon, VEHICLE_TYPE_MODE AS vehicle_type
FROM located JOIN modes USING (CRASH_RECORD_ID)
WHERE is_fatal AND VEHICLE_TYPE_MODE IN ('Brand#11', 'Brand#22', 'Brand#33')
  AND cast(CRASH_RECORD_ID as bigint) % 3 < 2""",
    )
    counts = """count(*) AS count, count(case when injury_any then 1 end) AS injured,
  count(case when is_fatal then 1 end) AS fatal"""
    sql["daily_counts_refreshed"] = _with(
        _CRASH,
        f"""SELECT cast(CRASH_DATETIME as date) AS CRASH_DATE, {counts}
FROM flagged WHERE CRASH_DATETIME IS NOT NULL GROUP BY 1""",
    )
    sql["cell_counts_refreshed"] = _with(
        _CRASH,
        f"""SELECT lat_bin, lon_bin, {counts}
FROM located WHERE CRASH_DATETIME >= timestamp '2001-01-01' GROUP BY 1, 2""",
    )
    sql["csv_broken_lines"] = _with(
        _CRASHES,
        """, lines AS (SELECT *, cast(CRASH_RECORD_ID as bigint) AS number, concat(CRASH_RECORD_ID, ',',
    coalesce(CRASH_DATE, ''), ',', coalesce(LATITUDE, ''), ',', coalesce(LONGITUDE, '')) AS whole FROM crashes)
SELECT 'good' AS kind, count(*) AS lines, count(LATITUDE) AS latitudes,
  cast(sum(length(CRASH_RECORD_ID)) as bigint) AS chars FROM lines WHERE number % 31 <> 0 AND number % 37 <> 0
UNION ALL SELECT 'broken', count(*), 0, cast(sum(case when number % 31 = 0 then length(CRASH_RECORD_ID) + 4
  else length(whole) + 5 end) as bigint) FROM lines WHERE number % 31 = 0 OR number % 37 = 0""",
    )
    sql["profile_crashes"] = _with(
        _CRASH,
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null,"
            f" count(*) - count({c}) AS nulls FROM clean"
            for c in _PROFILED
        ),
    )
    sql["crashes_as_json"] = _with(
        _CRASHES, "SELECT cast(to_json(crashes) as varchar) AS json FROM crashes"
    )
    sql["bounded_preview"] = _with(
        _CRASH,
        """SELECT CRASH_RECORD_ID, cast(CRASH_DATETIME as varchar) AS CRASH_DATETIME, HOUR,
  PRIM_CONTRIBUTORY_CAUSE
FROM clean c ORDER BY c.CRASH_DATETIME ASC NULLS LAST, CRASH_RECORD_ID LIMIT 1000""",
    )
    sql["hotspots_without_cause"] = _with(
        f"{_CRASH},\n{_CELLS}",
        """SELECT *, '' AS top_cause FROM cells
ORDER BY count DESC, fatal_count DESC, injury_rate DESC, lat_bin, lon_bin LIMIT 200""",
    )
    sql["fatal_points_without_cause"] = _with(
        _CRASH,
        f"""SELECT 'Fatalities' AS layer, LAT AS lat, LON AS lon, 4 AS radius, '#000' AS color,
  'Fatal crash' AS popup
FROM located WHERE is_fatal ORDER BY {heat} LIMIT 5000""",
    )
    sql["report_outputs"] = _with(
        f"{_CRASH},\n{_CELLS}",
        f"""SELECT 'daily_counts' AS name, concat_ws('|', cast(CRASH_DATETIME as date), count(*)) AS "row"
FROM clean WHERE CRASH_DATETIME IS NOT NULL GROUP BY cast(CRASH_DATETIME as date)
UNION ALL SELECT 'hotspot_layer', concat_ws('|', printf('%.3f', lat), printf('%.3f', lon),
  cast(greatest(4, least(30, floor(sqrt(count) * 3))) as integer),
  case when fatal_count > 0 then '#d73027' else '#1a9850' end,
  concat('Count: ', count, '<br>Injuries: ', injury_any_count, '<br>Fatal: ', fatal_count,
    '<br>Top cause: ', {_popup("top_cause")})) FROM ranked""",
    )
    charts = {
        "": "NULL",
        "HOUR": "HOUR",
        "CRASH_DATE": "cast(CRASH_DATETIME as date)",
        "CRASH_MONTH": "cast(date_trunc('month', CRASH_DATETIME) as timestamp)",
        "DAY_OF_WEEK": "coalesce(dayname(CRASH_DATETIME), 'Unknown')",
        "PRIM_CONTRIBUTORY_CAUSE": "PRIM_CONTRIBUTORY_CAUSE",
        "WEATHER_CONDITION": "WEATHER_CONDITION",
        "LIGHTING_CONDITION": "LIGHTING_CONDITION",
        "ROADWAY_SURFACE_COND": "upper(trim(ROADWAY_SURFACE_COND))",
    }
    sql["crash_charts"] = _with(
        _CRASH,
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS dimension, cast({value} as varchar) AS value, count(*) AS count,
  count(case when injury_any then 1 end) AS injured, count(case when is_fatal then 1 end) AS fatal,
  count(case when is_fatal then 1 end) AS deadly FROM flagged GROUP BY 2"""
            for name, value in charts.items()
        ),
    )
    sql["schema_tolerant_load"] = """WITH street AS (SELECT cast(o_orderkey as varchar) AS id,
  case when o_orderkey % 83 = 0 then null else cast(o_orderdate as date) end AS CRASH_DATE,
  case when o_orderkey % 71 = 0 then null else o_orderkey % 3 > 0 end AS injured,
  o_orderkey % 101 = 0 AS fatal FROM orders)
SELECT CRASH_DATE, 'UNKNOWN' AS PRIM_CONTRIBUTORY_CAUSE, count(id) AS crashes,
  count(case when injured then 1 end) AS injured, count(case when fatal then 1 end) AS fatal
FROM street GROUP BY 1"""
    sql["csv_tables"] = _with(
        merged,
        """SELECT HOUR, count(*) AS crashes, count(case when injury_any then 1 end) AS injured,
  cast(sum(persons) as bigint) AS persons, cast(sum(speeding_veh) as bigint) AS speeding_veh
FROM flagged LEFT JOIN ps USING (CRASH_RECORD_ID) LEFT JOIN vs USING (CRASH_RECORD_ID)
GROUP BY HOUR""",
    )
    return sql
