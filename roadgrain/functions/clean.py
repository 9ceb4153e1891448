"""Tolerant parsing and cleaning of all-string tables; a bad value becomes NULL, it never raises."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.functions.schema import DATE_NAMES, LAT_NAMES, LON_NAMES, resolve_preferred

# Date pattern, category columns, missing-value words and city bounding box.
US_PATTERN = "MM/dd/yyyy hh:mm:ss a"
CATEGORY_COLUMNS = (
    "PRIM_CONTRIBUTORY_CAUSE",
    "WEATHER_CONDITION",
    "LIGHTING_CONDITION",
    "TRAFFIC_CONTROL_DEVICE",
)
MISSING_WORDS = ("NAN", "NONE")
LAT_RANGE = (41.60, 42.10)
LON_RANGE = (-88.0, -87.3)
# Fixed value: clock time in free text, hour in group 1 and AM/PM in group 2.
CLOCK_PATTERN = r"(\d{1,2}):\d{2}:\d{2}\s*([AP]M)?"
STARTS_WITH_YEAR = r"^\d{4}(-|$)"
# ISO-like text whose time of day is followed by an offset or the name of a zone.
NAMES_ZONE = r"[T ]\d[\d:.]* *[A-Za-z+-]"
# Letters of a date pattern that stand for a zone, outside quoted text.
ZONE_LETTERS = r"[VzOXxZ]"
# Day names, Sunday first.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all of ``columns``; as plain IS NOT NULL tests, which reach the file scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def computed_once(df: DataFrame) -> DataFrame:
    """Work out the columns made so far once per row.

    The optimizer copies a column's expression into each later filter on it, which makes for slow
    and oversized generated code. It does not move filters below a projection that has the
    partition number in it. Columns that nobody uses are still left out.
    """
    return df.withColumn("__task", F.spark_partition_id()).where("__task >= 0").drop("__task")


def as_number(c: str | Column) -> Column:
    """Text to double, NULL where it is no finite number (``nan`` and ``Infinity`` are none)."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def utc_wall_time(instant: Column) -> Column:
    """The wall time in UTC of an instant, as a time without a zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def parse_format(c: Column, pattern: str) -> Column:
    """Time without a zone from text of one pattern; where the pattern has a zone, the wall time in UTC."""
    if re.search(ZONE_LETTERS, re.sub("'[^']*'", "", pattern)):
        return utc_wall_time(F.try_to_timestamp(c, F.lit(pattern)))
    return utc_wall_time(F.try_to_timestamp(F.concat(c, F.lit(" Z")), F.lit(f"{pattern} XXX")))


def parse_ts(c: str | Column, formats: Sequence[str] = (US_PATTERN,)) -> Column:
    """Time without a zone from the first of ``formats`` that fits, else from ISO-like text, else NULL.

    Text must hold a date: a time alone would be given the date of the day of the run. Wall times are
    taken as they are written and text that names its zone as the wall time in UTC, so that the result
    is the same in every session, also in hours that clock changes skip or repeat. A column that holds
    times already is read as its text.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    zoned = F.when(F.trim(c).rlike(NAMES_ZONE), utc_wall_time(F.try_to_timestamp(c)))
    iso = F.when(F.trim(c).rlike(STARTS_WITH_YEAR), zoned.otherwise(c.try_cast("timestamp_ntz")))
    return F.coalesce(*[parse_format(c, f) for f in formats], iso)


def with_datetime(
    df: DataFrame,
    candidates: Sequence[str] = DATE_NAMES,
    formats: Sequence[str] = (US_PATTERN,),
    name: str = "CRASH_DATETIME",
) -> DataFrame:
    """Add the parsed date of the first candidate column present; no candidate, no change."""
    found = resolve_preferred(df, candidates)
    return df if found is None else df.withColumn(name, parse_ts(found, formats))


def date_parts(df: DataFrame, ts: str = "CRASH_DATETIME") -> DataFrame:
    """Add YEAR, MONTH, DAY_OF_WEEK_NUM (1 is Sunday) and HOUR."""
    return df.withColumns(
        {
            "YEAR": F.year(ts),
            "MONTH": F.month(ts),
            "DAY_OF_WEEK_NUM": F.dayofweek(ts),
            "HOUR": F.hour(ts),
        }
    )


def weekday(ts: str | Column = "CRASH_DATETIME") -> Column:
    """English day name, NULL for a missing timestamp; by the date, as formatting would go through the session's zone."""
    return F.get(F.array(*map(F.lit, DAY_NAMES)), F.dayofweek(ts) - 1)


def day_name(ts: str | Column = "CRASH_DATETIME") -> Column:
    """English day name, ``Unknown`` for a missing timestamp."""
    return F.coalesce(weekday(ts), F.lit("Unknown"))


def month_start(ts: str | Column = "CRASH_DATETIME") -> Column:
    """The first instant of the month, without a zone."""
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def month_name(ts: str | Column = "CRASH_DATETIME") -> Column:
    """The month as ``yyyy-MM``."""
    return F.substring(F.to_date(ts).cast("string"), 1, 7)


def with_lat_lon(df: DataFrame) -> DataFrame:
    """Add LAT and LON as doubles from the first coordinate columns present."""
    found = {"LAT": resolve_preferred(df, LAT_NAMES), "LON": resolve_preferred(df, LON_NAMES)}
    return df.withColumns({n: as_number(c) for n, c in found.items() if c is not None})


def geo_null_out(
    df: DataFrame,
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
) -> DataFrame:
    """Set LAT and LON to NULL outside the box; both are judged on the incoming values."""
    if not {"LAT", "LON"} <= set(df.columns):
        return df
    inside = F.col("LAT").between(*lat_range) & F.col("LON").between(*lon_range)
    return df.withColumns({c: F.when(~inside, None).otherwise(F.col(c)) for c in ("LAT", "LON")})


def normalised(c: str | Column) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(c))


def category(c: str | Column, missing: Sequence[str] = MISSING_WORDS) -> Column:
    """Normalised text, NULL where it is one of the ``missing`` words."""
    text = normalised(c)
    return F.when(text.isin(*missing), None).otherwise(text) if missing else text


def clean_category(
    df: DataFrame,
    columns: Sequence[str] = CATEGORY_COLUMNS,
    missing: Sequence[str] = MISSING_WORDS,
) -> DataFrame:
    """Normalise those of ``columns`` the frame has."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: category(c, missing) for c in present}) if present else df


def hour_from_text(c: str | Column) -> Column:
    """Hour 0-23 from a clock time in the text, NULL when there is none or its hour is above 23.

    With AM or PM it is the hour modulo 12, plus 12 for PM.
    """
    hour = F.regexp_extract(c, CLOCK_PATTERN, 1).try_cast("int")
    half = F.regexp_extract(c, CLOCK_PATTERN, 2)
    of_day = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when(hour < 24, of_day)


def year_from_text(c: str | Column) -> Column:
    """First run of four digits, NULL when there is none."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
