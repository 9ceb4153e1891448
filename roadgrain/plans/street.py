"""Reading a crash table whose headers are not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import clean, features
from roadgrain.functions.schema import (
    crash_key,
    default_column,
    fatal_column,
    severity_columns,
    upper_columns,
)


def adapt(df: DataFrame) -> DataFrame:
    """Any crash table as key, date and text parts, injury and fatal flags, cause and weather.

    Columns are found by name; what is missing is filled with a default.
    """
    df = clean.with_datetime(upper_columns(df))
    key = crash_key(df)
    df = default_column(df, "CRASH_DATETIME", None, "timestamp_ntz")
    df = default_column(df, "PRIM_CONTRIBUTORY_CAUSE", "UNKNOWN")
    df = df.withColumns(
        {
            "injury_any": features.injury_any(severity_columns(df)),
            "is_fatal": features.fatal_flag(fatal_column(df)),
        }
    )
    return df.withColumnRenamed(key, "CRASH_KEY")


def daily_outcomes(df: DataFrame) -> DataFrame:
    """Per day of an adapted table: crashes, injury crashes and fatal ones; undated rows last."""
    days = df.groupBy(F.to_date("CRASH_DATETIME").alias("CRASH_DATE"), "PRIM_CONTRIBUTORY_CAUSE")
    return days.agg(
        F.count("CRASH_KEY").alias("crashes"),
        F.count_if("injury_any").alias("injured"),
        F.count_if("is_fatal").alias("fatal"),
    ).orderBy(F.asc_nulls_last("CRASH_DATE"))
