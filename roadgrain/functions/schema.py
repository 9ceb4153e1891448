"""Name-driven column lookup, done on ``df.columns`` while the plan is built (no job is run)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header names under which the source tables carry each field.
CRASH_KEY = "CRASH_RECORD_ID"
DATE_NAMES = ("CRASH_DATE", "CRASH_DATE_EST_I", "CRASH_DATE_TIMESTAMP", "DATE_POLICE_NOTIFIED")
LAT_NAMES = ("LATITUDE", "Y_COORDINATE", "LAT")
LON_NAMES = ("LONGITUDE", "X_COORDINATE", "LON")
STATE_NAMES = ("DRIVER_LICENSE_STATE", "DRVR_LIC_STATE", "LIC_PLATE_STATE")
AGE_NAMES = ("AGE", "DRIVER_AGE", "PERSON_AGE")
VEHICLE_ID_NAMES = ("VEHICLE_ID", "VEH_ID")
VEHICLE_TYPE_NAMES = ("VEHICLE_TYPE", "VEHICLE_MAKE", "VEHICLE_MODEL", "BODY_TYPE")
SURFACE_NAMES = ("ROADWAY_SURFACE_COND", "RDWY_SURF_COND")


def upper_columns(df: DataFrame) -> DataFrame:
    """Rename every column to upper case."""
    upper = [c.upper() for c in df.columns]
    return df if upper == df.columns else df.toDF(*upper)


def resolve_preferred(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First *candidate* the frame has; the order of the candidates decides."""
    present = set(df.columns)
    return next((c for c in candidates if c in present), None)


def resolve_in_frame_order(
    df: DataFrame, candidates: Iterable[str], contains: str | None = None
) -> str | None:
    """First *frame column* that is a candidate (ignoring case); the frame's order decides.

    With ``contains``, a column whose name holds that text is taken when no candidate is there.
    """
    wanted = {c.upper() for c in candidates}
    hit = next((c for c in df.columns if c.upper() in wanted), None)
    if hit is None and contains is not None:
        hit = next((c for c in df.columns if contains in c.upper()), None)
    return hit


def crash_key(df: DataFrame) -> str:
    """The crash key: ``CRASH_RECORD_ID`` or, failing that, the first column."""
    return resolve_preferred(df, [CRASH_KEY]) or df.columns[0]


def columns_matching(
    df: DataFrame,
    prefix: str | None = None,
    suffix: str | None = None,
    contains: Sequence[str] = (),
) -> list[str]:
    """Columns whose name starts with, ends with or contains one of the given texts."""
    return [
        c
        for c in df.columns
        if (prefix is not None and c.startswith(prefix))
        or (suffix is not None and c.endswith(suffix))
        or any(part in c for part in contains)
    ]


def severity_columns(df: DataFrame) -> list[str]:
    """Injury count columns: ``INJURIES*`` and ``*FATAL``."""
    return columns_matching(df, prefix="INJURIES", suffix="FATAL")


def fatal_column(df: DataFrame) -> str | None:
    """First column with ``FATAL`` in its name."""
    return next(iter(columns_matching(df, contains=["FATAL"])), None)


def default_column(df: DataFrame, name: str, value: object, dtype: str | None = None) -> DataFrame:
    """Add ``name`` as a literal when the frame lacks it."""
    if name in df.columns:
        return df
    lit = F.lit(value)
    return df.withColumn(name, lit if dtype is None else lit.cast(dtype))


def prefix_clashes(right: DataFrame, left: DataFrame, on: Sequence[str], prefix: str) -> DataFrame:
    """Prefix the non-key columns of ``right`` that ``left`` also has, so that a join keeps both."""
    taken = set(left.columns)
    return right.select(
        *[
            F.col(c).alias(prefix + c) if c in taken and c not in on else F.col(c)
            for c in right.columns
        ]
    )
