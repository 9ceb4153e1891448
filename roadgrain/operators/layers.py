"""Map layers as tables: one row per point with its popup, radius and colour."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions.clean import normalised, present
from roadgrain.functions.features import AGE_LABELS, safe_rate
from roadgrain.operators.aggregates import IMPACT_SUMS, group_mode, rank_causes
from roadgrain.operators.joins import join_hot
from roadgrain.operators.windows import capped, capped_each

# Colours.
FATAL_CELL, OTHER_CELL = "#d73027", "#1a9850"
FATAL_DOT, FATAL_CIRCLE = "#000", "#000000"
CAUSE_COLORS = ("#d7191c", "#fdae61", "#2c7bb6", "#abd9e9", "#1a9641")
AGE_COLORS = {
    "<16": "#984ea3",
    "16-24": "#e41a1c",
    "25-34": "#377eb8",
    "35-49": "#4daf4a",
    "50-64": "#ff7f00",
    "65+": "#a65628",
}


def _text(c: str) -> Column:
    """Popup text of a value; a missing one reads ``None``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _point() -> list[Column]:
    return [F.col("LAT").alias("lat"), F.col("LON").alias("lon")]


def heat_points(df: DataFrame, key: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """A random sample of ``n`` located crashes, or all of them."""
    located = present(df, "LAT", "LON")
    return capped(located, n, [key, "LAT", "LON"], seed=seed).select(key, *_point())


def marker_points(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``n`` (or all) located and dated crashes with the popup ``id | datetime``."""
    columns = ["LAT", "LON", key, "CRASH_DATETIME"]
    picked = capped(present(df, *columns), n, columns)
    return picked.select(*_point(), F.concat_ws(" | ", _text(key), _text("CRASH_DATETIME")).alias("popup"))


def hotspot_layer(cells: DataFrame) -> DataFrame:
    """Circles for ranked cells: radius by crash count, red where anyone died."""
    radius = F.greatest(F.lit(4), F.least(F.lit(30), F.floor(F.sqrt("count") * 3)))
    popup = F.concat(
        F.lit("Count: "), _text("count"),
        F.lit("<br>Injuries: "), _text("injury_any_count"),
        F.lit("<br>Fatal: "), _text("fatal_count"),
        F.lit("<br>Top cause: "), _text("top_cause"),
    )
    return cells.select(
        F.lit("Hotspots").alias("layer"),
        "lat",
        "lon",
        radius.cast("int").alias("radius"),
        F.when(F.col("fatal_flag"), FATAL_CELL).otherwise(OTHER_CELL).alias("color"),
        popup.alias("popup"),
    )


def period_heat(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Up to ``n`` (or all) points each for day and night; one set when the period is not known."""
    located = present(df, "LAT", "LON")
    if "period" not in located.columns:
        located = located.withColumn("period", F.lit("ALL"))
    picked = capped(located, n, [key, "LAT", "LON"], layer="period")
    return picked.select(F.col("period").alias("layer"), key, *_point())


def fatal_points(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Up to ``n`` (or all) fatal crashes; the popup has date and cause where the table has them."""
    told = {"CRASH_DATETIME": "", "PRIM_CONTRIBUTORY_CAUSE": "Cause: "}
    told = {c: label for c, label in told.items() if c in df.columns}
    fatal = present(df.where("is_fatal"), "LAT", "LON")
    popup = F.concat_ws(" | ", F.lit("Fatal crash"), *[F.concat(F.lit(label), _text(c)) for c, label in told.items()])
    return capped(fatal, n, [key, "LAT", "LON", *told]).select(
        F.lit("Fatalities").alias("layer"),
        *_point(),
        F.lit(4).alias("radius"),
        F.lit(FATAL_DOT).alias("color"),
        popup.alias("popup"),
    )


def top_cause_layers(
    df: DataFrame,
    key: str,
    k: int = 5,
    heat_cap: int | None = None,
    circle_cap: int | None = None,
    cause: str = "PRIM_CONTRIBUTORY_CAUSE",
) -> DataFrame:
    """Heat points and severity circles for the ``k`` causes with the highest impact.

    A missing cause takes a place among the ``k`` but gets no layer. Circles are the worst
    crashes by fatal, severe and total impact; ``heat_cap`` and ``circle_cap`` bound each layer.
    """
    needed = ["LAT", "LON", "impact_score", "inj_fatal", "inj_sev"]
    columns = [key, *needed]
    picks = {
        "heat": (heat_cap, ()),
        "circles": (circle_cap, [-F.col("inj_fatal"), -F.col("inj_sev"), -F.col("impact_score")]),
    }
    # Crashes without a place count for their cause but are no points.
    located = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    rows = df.withColumn("__point", located.cast("int"))
    sums = {"crashes": F.col("LAT").isNotNull().cast("int"), **{s: F.col(c) for s, c in IMPACT_SUMS.items()}}

    def top(causes: DataFrame) -> DataFrame:
        """The ``k`` causes with their rank."""
        ranks = Window.orderBy(
            *[F.desc_nulls_last(c) for c in ("total_impact", "fatalities", "crashes")],
            F.asc_nulls_last("cause"),
        )
        ranked = rank_causes(causes, k, cause).withColumn("rank", F.row_number().over(ranks) - 1)
        return ranked.withColumnRenamed("cause", cause).where(F.col(cause).isNotNull())

    picked = capped_each(rows, picks, columns, cause, "__point", sums=sums, choose=top)
    palette = F.array(*[F.lit(c) for c in CAUSE_COLORS])
    color = F.get(palette, F.col("rank") % len(CAUSE_COLORS))
    heat = picked["heat"].select(
        F.concat(F.lit("Cause: "), cause).alias("layer"),
        F.lit("heat").alias("kind"),
        key,
        *_point(),
        F.lit(10).alias("radius"),
        F.lit(None).cast("string").alias("color"),
    )
    circles = picked["circles"].select(
        F.concat(F.lit("Cause: "), cause).alias("layer"),
        F.lit("circle").alias("kind"),
        key,
        *_point(),
        (3 + F.least(F.lit(6), F.floor(F.sqrt("impact_score")))).cast("int").alias("radius"),
        F.when(F.col("inj_fatal") == 0, color).otherwise(FATAL_CIRCLE).alias("color"),
    )
    return heat.unionByName(circles)


def fatal_by_age_layers(groups: DataFrame, n: int | None = None) -> DataFrame:
    """Up to ``n`` (or all) fatal driver points per age label, from rows counted in ``fatal_drivers``."""
    colors = F.create_map(*[F.lit(x) for pair in AGE_COLORS.items() for x in pair])
    rows = groups.where((F.col("fatal_drivers") > 0) & F.col("age_bin").isin(*AGE_LABELS))
    picked = capped(
        present(rows, "LAT", "LON"),
        n,
        ["LAT", "LON", "CRASH_DATETIME"],
        "age_bin",
        weight="fatal_drivers",
    )
    return picked.select(
        F.concat(F.lit("Fatal drivers: Age "), "age_bin").alias("layer"),
        *_point(),
        F.lit(4).alias("radius"),
        F.element_at(colors, F.col("age_bin")).alias("color"),
        F.concat(F.lit("Age "), "age_bin", F.lit(" | "), _text("CRASH_DATETIME")).alias("popup"),
    )


def fatal_by_surface_layers(groups: DataFrame, k: int = 5, n: int | None = None) -> DataFrame:
    """Up to ``n`` (or all) fatal driver points for each of the ``k`` surfaces with the highest fatal share.

    ``groups`` are counted ``drivers`` and ``fatal_drivers`` by surface and place; shares count those
    without a place too.
    """
    located = F.col("LAT").isNotNull() & F.col("LON").isNotNull()
    rows = groups.withColumn("__points", F.when(located, F.col("fatal_drivers")).otherwise(0))
    sums = {c: F.col(c) for c in ("drivers", "fatal_drivers")}

    def top(surfaces: DataFrame) -> DataFrame:
        rate = safe_rate("fatal_drivers", "drivers")
        return surfaces.orderBy(rate.desc(), F.asc_nulls_last("surface")).limit(k).where("surface is not null")

    picked = capped_each(rows, {"": (n, ())}, ["LAT", "LON"], "surface", "__points", sums=sums, choose=top)
    return picked[""].select(F.concat(F.lit("Fatal: Surface "), "surface").alias("layer"), *_point())


def fatal_people_layers(people: DataFrame, crashes: DataFrame, key: str) -> DataFrame:
    """Located fatal crashes with the cyclists and the pedestrians in them.

    Own definition: only a finished map of it is known. People are counted per crash before the
    join.
    """
    kinds = ("BICYCLE", "PEDESTRIAN")
    kind = normalised("PERSON_TYPE")
    counted = (
        people.where(kind.isin(*kinds))
        .groupBy(key)
        .agg(*[F.count_if(kind == k).alias(k) for k in kinds])
    )
    fatal = present(crashes.where("is_fatal"), "LAT", "LON").select(key, "LAT", "LON")
    joined = join_hot(fatal, counted, [key], right_unique=True, how="inner")
    layers = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(k).alias("persons")) for k in kinds])
    return joined.select(key, *_point(), F.inline(layers)).where("persons > 0")


def fatal_vehicle_type_layer(
    crashes: DataFrame,
    vehicles: DataFrame,
    key: str,
    vehicle_type: str,
    types: Sequence[str],
    hit_run: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Located fatal crashes whose most frequent vehicle type is one of ``types``.

    Own definition: only a finished map of it is known. With ``hit_run``, a column of the crashes and
    its values in upper case, only crashes with one of these values are shown; which column that is
    depends on the tables. A column that is missing raises.
    """
    modes = group_mode(vehicles, [key], vehicle_type, "vehicle_type")
    fatal = present(crashes.where("is_fatal"), "LAT", "LON")
    if hit_run is not None:
        column, values = hit_run
        fatal = fatal.where(normalised(column).isin(*values))
    listed = modes.where(F.col("vehicle_type").isin(*types))
    joined = join_hot(
        fatal.select(key, "LAT", "LON"), listed, [key], right_unique=True, how="inner"
    )
    return joined.select(key, *_point(), "vehicle_type")
