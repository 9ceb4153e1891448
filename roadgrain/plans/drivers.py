"""Driver-grain frames: one row per driver, or rows counted per group of drivers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.functions import clean, features
from roadgrain.functions.schema import (
    AGE_NAMES,
    STATE_NAMES,
    SURFACE_NAMES,
    crash_key,
    prefix_clashes,
    resolve_in_frame_order,
    upper_columns,
)
from roadgrain.operators.joins import (
    HOT_ROWS,
    driver_groups,
    drivers,
    drivers_with_crashes,
    drivers_with_vehicles,
    flag_members,
    hot_lists,
    parts_for,
    vehicle_join_keys,
)
from roadgrain.sources.keyed import SLOT, Keyed
from roadgrain.sources.tables import Tables

# Columns of the driver table.
DRIVER_COLUMNS = (
    "CRASH_DATETIME",
    "HOUR",
    "YEAR",
    "LAT",
    "LON",
    "fatal_outcome",
    "age_bin",
    "license_state",
    "surface",
    "PRIM_CONTRIBUTORY_CAUSE",
)


def driver_people(people: DataFrame) -> DataFrame:
    """Drivers with age_bin and license_state."""
    df = drivers(upper_columns(people))
    age, state = (resolve_in_frame_order(df, names) for names in (AGE_NAMES, STATE_NAMES))
    return df.withColumns(
        {
            "age_bin": features.age_bin(age),
            "license_state": F.lit("UNKNOWN") if state is None else clean.normalised(state),
        }
    )


def driver_crashes(crashes: DataFrame, fatalities: DataFrame | None = None) -> DataFrame:
    """Crashes with parsed date and coordinates (not cut to the city), fatal_outcome and surface."""
    df = clean.with_lat_lon(clean.with_datetime(upper_columns(crashes)))
    if "CRASH_DATETIME" in df.columns:
        df = clean.date_parts(df)
    df = clean.computed_once(df)
    surface = resolve_in_frame_order(df, SURFACE_NAMES)
    df = df.withColumn("surface", F.lit("UNKNOWN") if surface is None else clean.normalised(surface))
    column, key = resolve_in_frame_order(df, ["INJURIES_FATAL"]), crash_key(df)
    if column is None and fatalities is not None and key in fatalities.columns:
        return flag_members(df, fatalities, key, "fatal_outcome")
    return df.withColumn("fatal_outcome", features.fatal_flag(column))


def joined_drivers(tables: Tables, min_rows: int = HOT_ROWS) -> DataFrame:
    """One row per driver, matching vehicle and crash, with the columns of all three.

    Rows and hot keys are counted while the plan is built, so that it salts only where there are any and
    the joins get as many tasks as the rows need.
    """
    crashes = driver_crashes(tables.crashes, tables.fatalities)
    key = crash_key(crashes)
    people, vehicles = driver_people(tables.people), upper_columns(tables.vehicles)
    sides, keys = [], vehicle_join_keys(people, vehicles, key)
    if keys is not None:
        sides += [(people, keys[0]), (vehicles.withColumnRenamed(keys[1], keys[0][-1]), keys[0])]
    if key in people.columns:
        sides += [(people, [key]), (upper_columns(tables.crashes), [key])]
    hot, rows = hot_lists(sides, min_rows) if sides else ([], [])
    tasks = [parts_for(sum(rows[i : i + 2])) for i in range(0, len(rows), 2)]
    by_vehicle = (hot.pop(0), hot.pop(0)) if keys is not None else None
    pv = drivers_with_vehicles(people, vehicles, key, min_rows, by_vehicle, tasks.pop(0) if keys is not None else None)
    return _with_outcome(drivers_with_crashes(pv, crashes, key, min_rows, people, tuple(hot) or None, tasks.pop(0) if tasks else None))


def keyed_drivers(store: Keyed, fatalities: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`joined_drivers` from tables stored by key: the joins need no shuffle."""
    on = [store.key, SLOT]
    people, crashes = driver_people(store.people), driver_crashes(store.crashes, fatalities)
    pv = people.join(prefix_clashes(store.vehicles, people, on, "VEH_"), on, "left")
    return _with_outcome(pv.join(prefix_clashes(crashes, pv, on, "CRASH_"), on, "left").drop(SLOT))


def _with_outcome(joined: DataFrame) -> DataFrame:
    return joined.withColumn("fatal_outcome", F.coalesce("fatal_outcome", F.lit(False)))


def driver_features(joined: DataFrame, key: str) -> DataFrame:
    """The driver table of joined driver rows: crash key, time, place, outcome, age, state, surface and crash cause."""
    if "CRASH_PRIM_CONTRIBUTORY_CAUSE" in joined.columns:
        joined = joined.withColumn("PRIM_CONTRIBUTORY_CAUSE", F.col("CRASH_PRIM_CONTRIBUTORY_CAUSE"))
    return joined.select(key, *[c for c in DRIVER_COLUMNS if c in joined.columns])


def counted_drivers(
    tables: Tables, person_dims: Sequence[str] = (), crash_dims: Sequence[str] = ()
) -> DataFrame:
    """Driver rows counted by the given columns of :func:`driver_features`."""
    crashes = driver_crashes(tables.crashes, tables.fatalities)
    return driver_groups(
        driver_people(tables.people),
        upper_columns(tables.vehicles),
        crashes,
        crash_key(crashes),
        person_dims,
        crash_dims,
    )


def fatal_driver_points(tables: Tables, person_dims: Sequence[str], crash_dims: Sequence[str]) -> DataFrame:
    """Like :func:`counted_drivers` for located fatal crashes only, which are picked before the join."""
    crashes = driver_crashes(tables.crashes, tables.fatalities)
    fatal = clean.present(crashes.where("fatal_outcome"), "LAT", "LON")
    return driver_groups(
        driver_people(tables.people),
        upper_columns(tables.vehicles),
        fatal,
        crash_key(crashes),
        person_dims,
        crash_dims,
        matched_only=True,
    )
