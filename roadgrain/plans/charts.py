"""The crash-grain charts from one counted frame: one scan of the crashes serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import clean
from roadgrain.functions.features import non_fatal, safe_rate
from roadgrain.operators import aggregates as agg
from roadgrain.operators.windows import rolling_mean

CAUSE, WEATHER, LIGHT, SURFACE = "PRIM_CONTRIBUTORY_CAUSE", "WEATHER_CONDITION", "LIGHTING_CONDITION", "ROADWAY_SURFACE_COND"
#: Cases that are counted besides all crashes: injured, fatal by any count column, fatal by the count of deaths.
FLAGS = ("injured", "fatal", "deadly")


def crash_counts(crashes: DataFrame) -> DataFrame:
    """Crashes counted by each dimension of the charts and as a whole, in one pass.

    ``crashes`` are cleaned ones with ``injury_any``, ``is_fatal_any`` and ``is_fatal``. Dimensions
    whose column is missing are left out.
    """
    dims = {"HOUR": F.col("HOUR")} if "HOUR" in crashes.columns else {}
    if "CRASH_DATETIME" in crashes.columns:
        dims |= {
            "CRASH_DATE": F.to_date("CRASH_DATETIME"),
            "CRASH_MONTH": clean.month_start(),
            "DAY_OF_WEEK": clean.day_name(),
        }
    dims |= {c: F.col(c) for c in (CAUSE, WEATHER, LIGHT, SURFACE) if c in crashes.columns}
    flags = {"injured": F.col("injury_any"), "fatal": F.col("is_fatal_any"), "deadly": F.col("is_fatal")}
    return agg.counts_by_each(crashes, dims, flags)


def _of(counts: DataFrame, dimension: str) -> DataFrame:
    return counts.where(F.col("dimension") == dimension).select(dimension, "count", *FLAGS)


def daily_counts(counts: DataFrame) -> DataFrame:
    return clean.present(_of(counts, "CRASH_DATE"), "CRASH_DATE").select("CRASH_DATE", "count").orderBy("CRASH_DATE")


def monthly_counts(counts: DataFrame) -> DataFrame:
    return clean.present(_of(counts, "CRASH_MONTH"), "CRASH_MONTH").select("CRASH_MONTH", "count").orderBy("CRASH_MONTH")


def rolling7_daily(counts: DataFrame) -> DataFrame:
    return rolling_mean(daily_counts(counts), "CRASH_DATE", "count", 7, "rolling7")


def hour_counts(counts: DataFrame) -> DataFrame:
    return clean.present(_of(counts, "HOUR"), "HOUR").select("HOUR", "count").orderBy("HOUR")


def dow_counts(counts: DataFrame) -> DataFrame:
    days = _of(counts, "DAY_OF_WEEK").select("DAY_OF_WEEK", "count")
    return agg.fill_domain(days, "DAY_OF_WEEK", agg.DAYS, {"count": F.lit(0).cast("long")})


def injury_share(counts: DataFrame) -> DataFrame:
    whole = counts.where("dimension = ''").select(F.col("count").alias("crashes"), "injured")
    return whole.withColumn("injury_share", safe_rate("injured", "crashes"))


def top_causes(counts: DataFrame) -> DataFrame:
    return _of(counts, CAUSE).select(CAUSE, "count").orderBy(F.desc("count"), F.asc_nulls_last(CAUSE)).limit(12)


def injury_rate_by_weather(counts: DataFrame) -> DataFrame:
    rated = _of(counts, WEATHER).select(WEATHER, safe_rate("injured", "count").alias("injury_rate"))
    return rated.orderBy(F.desc("injury_rate"), F.asc_nulls_last(WEATHER)).limit(10)


def hourly_fatal(counts: DataFrame) -> DataFrame:
    hours = clean.present(_of(counts, "HOUR"), "HOUR").select("HOUR", F.col("count").alias("total"), F.col("deadly").alias("fatal"))
    hours = hours.withColumn("nonfatal", non_fatal("total", "fatal"))
    rates = {"fatal_rate": safe_rate("fatal", "total"), "nonfatal_rate": safe_rate("nonfatal", "total")}
    return hours.withColumns(rates).orderBy("HOUR")


def _topk_rate(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda counts: agg.topk_group_fatal_rate(_of(counts, column), column, 8, ("count", "deadly"))


#: Charts under the names of their analyses, and the dimension that each needs.
CHARTS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "daily_counts": ("CRASH_DATE", daily_counts),
    "monthly_counts": ("CRASH_MONTH", monthly_counts),
    "rolling7_daily": ("CRASH_DATE", rolling7_daily),
    "hour_counts": ("HOUR", hour_counts),
    "dow_counts": ("DAY_OF_WEEK", dow_counts),
    "injury_share": ("", injury_share),
    "top_causes": (CAUSE, top_causes),
    "injury_rate_by_weather": (WEATHER, injury_rate_by_weather),
    "hourly_fatal": ("HOUR", hourly_fatal),
    "topk_rate_lighting": (LIGHT, _topk_rate(LIGHT)),
    "topk_rate_weather": (WEATHER, _topk_rate(WEATHER)),
    "topk_rate_surface": (SURFACE, _topk_rate(SURFACE)),
}
