"""Per-row features: severity, period, grid cell, age group and impact score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.functions.clean import as_number
from roadgrain.functions.schema import resolve_in_frame_order

# Age labels with their inclusive bounds, and points per injured person.
AGE_BOUNDS = {
    "16-24": (16, 24),
    "25-34": (25, 34),
    "35-49": (35, 49),
    "50-64": (50, 64),
}
AGE_LABELS = ("<16", "16-24", "25-34", "35-49", "50-64", "65+")
IMPACT_POINTS = {
    "INJURIES_FATAL": 10,
    "INJURIES_INCAPACITATING": 5,
    "INJURIES_NON_INCAPACITATING": 2,
    "INJURIES_POSSIBLE": 1,
}
IMPACT_COLUMNS = {
    "INJURIES_FATAL": "inj_fatal",
    "INJURIES_INCAPACITATING": "inj_sev",
    "INJURIES_NON_INCAPACITATING": "inj_nonsev",
    "INJURIES_POSSIBLE": "inj_possible",
}


def injury_any(columns: Sequence[str]) -> Column:
    """True when any count is above zero; NULL when none is but one is missing."""
    if not columns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [as_number(c) > 0 for c in columns])


def fatal_flag(column: str | None) -> Column:
    """True when the count is above zero, else false, also for a missing count."""
    return F.lit(False) if column is None else F.coalesce(as_number(column) > 0, F.lit(False))


def period(hour: str | Column = "HOUR") -> Column:
    """``DAY`` from 6 to 19 o'clock, ``NIGHT`` otherwise and for a missing hour."""
    hour = F.col(hour) if isinstance(hour, str) else hour
    return F.when(hour.between(6, 19), "DAY").otherwise("NIGHT")


def with_grid_bin(df: DataFrame, digits: int = 3) -> DataFrame:
    """Add lat_bin and lon_bin, the coordinates rounded half up."""
    return df.withColumns({"lat_bin": F.round("LAT", digits), "lon_bin": F.round("LON", digits)})


def age_bin(age: str | Column | None) -> Column:
    """Age label; text, gaps between whole years and missing ages are ``UNKNOWN``."""
    if age is None:
        return F.lit("UNKNOWN")
    years = as_number(age)
    label = F.when(years < 16, "<16")
    for name, (low, high) in AGE_BOUNDS.items():
        label = label.when(years.between(low, high), name)
    return label.when(years >= 65, "65+").otherwise("UNKNOWN")


def with_impact(df: DataFrame, points: Mapping[str, int] = IMPACT_POINTS) -> DataFrame:
    """Add the injury counts as doubles and ``impact_score``, their weighted sum.

    A missing count makes the score NULL; a missing column counts as zero.
    """
    found = {src: resolve_in_frame_order(df, [src]) for src in points}
    counts = {
        IMPACT_COLUMNS.get(src, src.lower()): F.lit(0.0) if col is None else as_number(col)
        for src, col in found.items()
    }
    df = df.withColumns(counts)
    terms = [F.col(name) * float(points[src]) for name, src in zip(counts, points, strict=True)]
    return df.withColumn("impact_score", reduce(lambda a, b: a + b, terms))


def safe_rate(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as a double, 0 where ``den`` is not above zero."""
    num, den = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def non_fatal(total: str, fatal: str) -> Column:
    """Cases left after taking out the fatal ones."""
    return F.col(total) - F.col(fatal)
