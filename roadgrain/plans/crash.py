"""Crash-grain frames that the analyses share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import clean, features
from roadgrain.functions.schema import (
    CRASH_KEY,
    SURFACE_NAMES,
    VEHICLE_TYPE_NAMES,
    crash_key,
    fatal_column,
    resolve_in_frame_order,
    severity_columns,
    upper_columns,
)
from roadgrain.operators.aggregates import (
    group_mode,
    people_summary,
    vehicles_summary,
)
from roadgrain.operators.joins import attach_summaries, flag_members
from roadgrain.sources.tables import Tables


def clean_crashes(crashes: DataFrame) -> DataFrame:
    """Parsed dates with their parts, coordinates inside the city, normalised categories."""
    df = clean.with_lat_lon(clean.with_datetime(upper_columns(crashes)))
    if "CRASH_DATETIME" in df.columns:
        df = clean.date_parts(df)
    return clean.computed_once(clean.clean_category(clean.geo_null_out(df)))


def combined(tables: Tables) -> DataFrame:
    """Cleaned crashes with their people and vehicle counts."""
    crashes = clean_crashes(tables.crashes)
    key = crash_key(crashes)
    return attach_summaries(
        crashes,
        people_summary(upper_columns(tables.people), key),
        vehicles_summary(upper_columns(tables.vehicles), key),
        key,
    )


def with_flags(crashes: DataFrame, fatalities: DataFrame | None = None) -> DataFrame:
    """Add injury_any and is_fatal; without a fatal count, the list of fatalities decides."""
    df = crashes.withColumn("injury_any", features.injury_any(severity_columns(crashes)))
    column, key = fatal_column(crashes), crash_key(crashes)
    if column is None and fatalities is not None and key in fatalities.columns:
        return flag_members(df, fatalities, key, "is_fatal")
    return df.withColumn("is_fatal", features.fatal_flag(column))


def located(flagged: DataFrame) -> DataFrame:
    """Flagged crashes with coordinates, with their period and grid cell."""
    df = clean.present(flagged, "LAT", "LON")
    if "HOUR" in df.columns:
        df = df.withColumn("period", features.period())
    return features.with_grid_bin(df)


def impact(crashes: DataFrame) -> DataFrame:
    """Crashes with injury counts as numbers and their impact score."""
    cause = "PRIM_CONTRIBUTORY_CAUSE"
    if cause in crashes.columns:
        df = crashes.withColumn(cause, clean.normalised(cause))
    else:
        df = crashes.withColumn(cause, F.lit("UNKNOWN"))
    return features.with_impact(df)


def distribution(crashes: DataFrame, fatalities: DataFrame | None = None) -> DataFrame:
    """Crashes with is_fatal, day name and normalised categories for the distribution charts."""
    column = resolve_in_frame_order(crashes, ["INJURIES_FATAL"])
    key = crash_key(crashes)
    if column is None and fatalities is not None and key in fatalities.columns:
        df = flag_members(crashes, fatalities, key, "is_fatal")
    else:
        df = crashes.withColumn("is_fatal", features.fatal_flag(column))
    if "CRASH_DATETIME" in df.columns:
        df = df.withColumn("DAY_OF_WEEK", clean.weekday())
    names = ("LIGHTING_CONDITION", "WEATHER_CONDITION", "PRIM_CONTRIBUTORY_CAUSE")
    return clean.clean_category(df, (*names, SURFACE_NAMES[0]), ())


def vehicle_type_column(vehicles: DataFrame) -> str | None:
    """The vehicle type column, in frame order."""
    return resolve_in_frame_order(vehicles, VEHICLE_TYPE_NAMES)


def vehicle_modes(vehicles: DataFrame, key: str = CRASH_KEY) -> DataFrame:
    """Most frequent vehicle type per crash."""
    return group_mode(vehicles, [key], vehicle_type_column(vehicles), "VEHICLE_TYPE_MODE")


def vehicle_mode_groups(crashes: DataFrame, vehicles: DataFrame, key: str = CRASH_KEY) -> DataFrame:
    """Crashes and fatal crashes counted by key, with their modal vehicle type.

    Counting by key first costs no further shuffle, as the join is on that key, and a repeated
    key reaches the join as one row.
    """
    counted = crashes.groupBy(key).agg(
        F.count(F.lit(1)).alias("crashes"), F.count_if("is_fatal").alias("fatal_crashes")
    )
    typed = counted.join(vehicle_modes(vehicles, key), key, "left")
    return typed.select("VEHICLE_TYPE_MODE", "crashes", "fatal_crashes")
