"""Every analysis as a function of the crash tables, under its name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import clean, features
from roadgrain.functions.features import AGE_LABELS
from roadgrain.functions.schema import CRASH_KEY as KEY
from roadgrain.functions.schema import crash_key, upper_columns
from roadgrain.operators import aggregates as agg
from roadgrain.operators import layers
from roadgrain.operators.windows import rolling_mean
from roadgrain.plans import crash, drivers
from roadgrain.sources import sinks
from roadgrain.sources.tables import Tables

DRIVERS = ("drivers", "fatal_drivers")
CAUSE = "PRIM_CONTRIBUTORY_CAUSE"
# Most points per layer.
HEAT_CAP = 50_000
MARKER_CAP = 3_000
FATAL_CAP = 5_000
CIRCLE_CAP = 2_000
AGE_CAP = 3_000
SURFACE_CAP = 40_000


class CrashData:
    """The crash tables and the frames derived from them; ``clean`` may come ready-made.

    Headers are put in upper case, and the crash key is named ``CRASH_RECORD_ID`` in each table
    that has it, whatever its name in the crashes. ``heavy_types`` names the vehicle types of
    ``fatal_vehicle_type_layer``, ``hit_run`` the column and values that mark hit-and-run.
    Times carry no zone, so that results do not depend on the session's one.
    """

    def __init__(
        self,
        tables: Tables,
        clean: DataFrame | None = None,
        heavy_types: Sequence[str] = (),
        hit_run: tuple[str, Sequence[str]] | None = None,
    ):
        self.heavy_types = tuple(heavy_types)
        self.hit_run = hit_run
        upper = [upper_columns(df) for df in tables]
        key = crash_key(upper[0])
        named = upper if key == KEY else [df.withColumnRenamed(key, KEY) for df in upper]
        self.tables = Tables(*named)
        self.clean = crash.clean_crashes(self.tables.crashes) if clean is None else clean

    @cached_property
    def flagged(self) -> DataFrame:
        return crash.with_flags(self.clean, self.tables.fatalities)

    @cached_property
    def located(self) -> DataFrame:
        return crash.located(self.flagged)

    @cached_property
    def impact(self) -> DataFrame:
        return crash.impact(self.clean)

    @cached_property
    def counted(self) -> DataFrame:
        """Crashes with both fatal flags, for :func:`roadgrain.plans.charts.crash_counts`."""
        flagged = self.flagged.withColumnRenamed("is_fatal", "is_fatal_any")
        return crash.distribution(flagged, self.tables.fatalities)

    @cached_property
    def distribution(self) -> DataFrame:
        return crash.distribution(self.clean, self.tables.fatalities)


Analysis = Callable[[CrashData], DataFrame]
ANALYSES: dict[str, Analysis] = {}


def analysis(fn: Analysis) -> Analysis:
    """List a function under its name."""
    ANALYSES[fn.__name__] = fn
    return fn


# --- Crash-level trends ---------------------------------------------------------------------


@analysis
def daily_counts(d: CrashData) -> DataFrame:
    return agg.daily_counts(d.clean)


@analysis
def monthly_counts(d: CrashData) -> DataFrame:
    return agg.monthly_counts(d.clean)


@analysis
def rolling7_daily(d: CrashData) -> DataFrame:
    return rolling_mean(agg.daily_counts(d.clean), "CRASH_DATE", "count", 7, "rolling7")


@analysis
def hour_counts(d: CrashData) -> DataFrame:
    return agg.hour_counts(d.clean)


@analysis
def dow_counts(d: CrashData) -> DataFrame:
    return agg.dow_counts(d.clean)


@analysis
def date_parts(d: CrashData) -> DataFrame:
    parts = ("YEAR", "MONTH", "DAY_OF_WEEK_NUM", "HOUR")
    return d.clean.select(KEY, *parts, clean.day_name().alias("DAY_OF_WEEK"))


@analysis
def hour_year_from_text(d: CrashData) -> DataFrame:
    return d.tables.crashes.select(
        KEY,
        clean.hour_from_text("CRASH_DATE").alias("HOUR"),
        clean.year_from_text("CRASH_DATE").alias("YEAR"),
    )


@analysis
def geo_clean(d: CrashData) -> DataFrame:
    return d.clean.select(KEY, "LAT", "LON")


@analysis
def clean_categories(d: CrashData) -> DataFrame:
    return d.clean.select(KEY, *clean.CATEGORY_COLUMNS)


@analysis
def people_summary(d: CrashData) -> DataFrame:
    return agg.people_summary(d.tables.people, KEY)


@analysis
def vehicles_summary(d: CrashData) -> DataFrame:
    return agg.vehicles_summary(d.tables.vehicles, KEY)


@analysis
def crash_combined(d: CrashData) -> DataFrame:
    counts = (*agg.PEOPLE_COUNTS, *agg.VEHICLE_COUNTS)
    return crash.combined(d.tables).select(KEY, CAUSE, "LAT", "LON", "HOUR", *counts)


@analysis
def injury_flags(d: CrashData) -> DataFrame:
    return d.flagged.select(KEY, "injury_any", "is_fatal")


@analysis
def injury_share(d: CrashData) -> DataFrame:
    return agg.injury_share(d.flagged)


@analysis
def top_causes(d: CrashData) -> DataFrame:
    return agg.value_counts(d.clean, CAUSE, 12)


@analysis
def injury_rate_by_weather(d: CrashData) -> DataFrame:
    return agg.injury_rate_by(d.flagged, "WEATHER_CONDITION", 10)


@analysis
def heat_sample(d: CrashData) -> DataFrame:
    return layers.heat_points(d.clean, KEY, HEAT_CAP)


@analysis
def median_center(d: CrashData) -> DataFrame:
    return agg.median_center(d.clean)


@analysis
def marker_points(d: CrashData) -> DataFrame:
    return layers.marker_points(d.clean, KEY, MARKER_CAP)


# --- Hotspots and impact --------------------------------------------------------------------


@analysis
def period_counts(d: CrashData) -> DataFrame:
    return agg.value_counts(d.located, "period")


@analysis
def hotspot_cells(d: CrashData) -> DataFrame:
    return agg.hotspot_cells(d.located).drop("top_cause")


@analysis
def cell_top_cause(d: CrashData) -> DataFrame:
    return agg.group_mode(d.located, ["lat_bin", "lon_bin"], CAUSE, "top_cause")


@analysis
def hotspots_top200(d: CrashData) -> DataFrame:
    cause = CAUSE if CAUSE in d.located.columns else None
    return agg.rank_cells(agg.hotspot_cells(d.located, cause), 200)


@analysis
def hotspot_layer(d: CrashData) -> DataFrame:
    return layers.hotspot_layer(hotspots_top200(d))


@analysis
def period_heat(d: CrashData) -> DataFrame:
    return layers.period_heat(d.located, KEY, HEAT_CAP)


@analysis
def fatal_points(d: CrashData) -> DataFrame:
    return layers.fatal_points(d.located, KEY, FATAL_CAP)


@analysis
def cause_impact(d: CrashData) -> DataFrame:
    return agg.cause_impact(d.impact)


@analysis
def cause_impact_top5(d: CrashData) -> DataFrame:
    return agg.rank_causes(agg.cause_impact(d.impact), 5)


@analysis
def impact_scores(d: CrashData) -> DataFrame:
    counts = tuple(features.IMPACT_COLUMNS.values())
    return d.impact.select(KEY, *counts, "impact_score")


@analysis
def top_cause_layers(d: CrashData) -> DataFrame:
    return layers.top_cause_layers(d.impact, KEY, heat_cap=HEAT_CAP, circle_cap=CIRCLE_CAP)


@analysis
def risk_cells(d: CrashData) -> DataFrame:
    return agg.risk_cells(features.with_grid_bin(clean.present(d.impact, "LAT", "LON")))


# --- Driver-level fatality patterns ---------------------------------------------------------


@analysis
def drivers_joined(d: CrashData) -> DataFrame:
    return drivers.joined_drivers(d.tables).select(
        "PERSON_ID", KEY, "VEHICLE_ID", "VEHICLE_TYPE", "CRASH_DATE", "fatal_outcome"
    )


@analysis
def driver_features(d: CrashData) -> DataFrame:
    return sinks.timestamps_as_text(drivers.driver_features(drivers.joined_drivers(d.tables), KEY))


@analysis
def fatal_rate_by_age(d: CrashData) -> DataFrame:
    rates = agg.fatal_rate(drivers.counted_drivers(d.tables, ["age_bin"]), "age_bin", DRIVERS)
    return agg.fill_domain(rates, "age_bin", AGE_LABELS, {"fatal_rate": F.lit(0.0)})


@analysis
def fatal_rate_by_state_top10(d: CrashData) -> DataFrame:
    groups = drivers.counted_drivers(d.tables, ["license_state"])
    return agg.topk_group_fatal_rate(groups, "license_state", 10, DRIVERS)


@analysis
def fatal_rate_by_surface(d: CrashData) -> DataFrame:
    groups = drivers.counted_drivers(d.tables, (), ["surface"])
    return agg.group_fatal_rate(groups, "surface", DRIVERS, k=10)


@analysis
def approx_center(d: CrashData) -> DataFrame:
    points = drivers.fatal_driver_points(d.tables, (), ["LAT", "LON"])
    return agg.approx_center(points, weight="fatal_drivers")


@analysis
def fatal_driver_center(d: CrashData) -> DataFrame:
    points = drivers.fatal_driver_points(d.tables, (), ["LAT", "LON"])
    return agg.median_center(points, "fatal_drivers")


@analysis
def fatal_by_age_layers(d: CrashData) -> DataFrame:
    dims = ["LAT", "LON", "CRASH_DATETIME"]
    return layers.fatal_by_age_layers(drivers.fatal_driver_points(d.tables, ["age_bin"], dims), AGE_CAP)


@analysis
def fatal_by_surface_layers(d: CrashData) -> DataFrame:
    groups = drivers.counted_drivers(d.tables, (), ["surface", "LAT", "LON"])
    return layers.fatal_by_surface_layers(groups, 5, SURFACE_CAP)


@analysis
def fatal_people_layers(d: CrashData) -> DataFrame:
    return layers.fatal_people_layers(d.tables.people, d.flagged, KEY)


# --- Distributions over crashes -------------------------------------------------------------


@analysis
def fatal_ref_flag(d: CrashData) -> DataFrame:
    counted = d.tables.crashes.drop("INJURIES_FATAL")
    return crash.distribution(crash.clean_crashes(counted), d.tables.fatalities).select(KEY, "is_fatal")


@analysis
def hourly_fatal(d: CrashData) -> DataFrame:
    return agg.hourly_fatal(d.distribution)


@analysis
def topk_rate_lighting(d: CrashData) -> DataFrame:
    return agg.topk_group_fatal_rate(d.distribution, "LIGHTING_CONDITION", 8)


@analysis
def topk_rate_weather(d: CrashData) -> DataFrame:
    return agg.topk_group_fatal_rate(d.distribution, "WEATHER_CONDITION", 8)


@analysis
def topk_rate_surface(d: CrashData) -> DataFrame:
    return agg.topk_group_fatal_rate(d.distribution, "ROADWAY_SURFACE_COND", 8)


@analysis
def vehicle_mode(d: CrashData) -> DataFrame:
    return crash.vehicle_modes(d.tables.vehicles)


@analysis
def fatal_rate_by_vehicle_mode(d: CrashData) -> DataFrame:
    groups = crash.vehicle_mode_groups(d.distribution, d.tables.vehicles)
    return agg.topk_group_fatal_rate(groups, "VEHICLE_TYPE_MODE", 8, ("crashes", "fatal_crashes"))


@analysis
def fatal_vehicle_type_layer(d: CrashData) -> DataFrame:
    return layers.fatal_vehicle_type_layer(
        d.flagged, d.tables.vehicles, KEY, crash.vehicle_type_column(d.tables.vehicles), d.heavy_types, d.hit_run
    )


# --- Sources and sinks ----------------------------------------------------------------------


@analysis
def profile_crashes(d: CrashData) -> DataFrame:
    return sinks.profile(d.clean)


@analysis
def crashes_as_json(d: CrashData) -> DataFrame:
    return sinks.json_rows(d.tables.crashes)


@analysis
def bounded_preview(d: CrashData) -> DataFrame:
    columns = [KEY, "CRASH_DATETIME", "HOUR", CAUSE]
    order = [F.asc_nulls_last("CRASH_DATETIME"), KEY]
    return sinks.bounded(d.clean, columns, 1000, order)
