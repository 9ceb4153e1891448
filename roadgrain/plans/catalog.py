"""Every analysis under its query name, over the crash-shaped test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.functions import features
from roadgrain.functions.schema import severity_columns
from roadgrain.plans import charts, crash, drivers, street
from roadgrain.plans.analyses import ANALYSES, Analysis, CrashData
from roadgrain.plans.report import read_report, write_report
from roadgrain.sources import monthly, sinks
from roadgrain.sources.keyed import write_keyed
from roadgrain.sources.tables import Tables, load_tables, split_csv
from roadgrain.sources.views import crash_tables, street_reports

Query = Callable[[SparkSession, str], DataFrame]


# Vehicle types taken as heavy in the test tables, which hold no real ones.
HEAVY_TYPES = ("Brand#11", "Brand#22", "Brand#33")


def _over_test_tables(fn: Analysis) -> Query:
    return lambda spark, sf_dir: fn(CrashData(crash_tables(spark, sf_dir), heavy_types=HEAVY_TYPES))


def queries() -> dict[str, Query]:
    found = {name: _over_test_tables(fn) for name, fn in ANALYSES.items()}
    more = (schema_tolerant_load, csv_tables, hotspots_without_cause, fatal_points_without_cause, report_outputs, driver_features_keyed, crash_charts)
    more += (csv_broken_lines, daily_counts_refreshed, cell_counts_refreshed, fatal_hit_run_layer)
    return found | {fn.__name__: fn for fn in more}


def _without(spark: SparkSession, sf_dir: str, *columns: str) -> CrashData:
    tables = crash_tables(spark, sf_dir)
    return CrashData(tables._replace(crashes=tables.crashes.drop(*columns)))


def hotspots_without_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst cells of a table that has no cause column."""
    return ANALYSES["hotspots_top200"](_without(spark, sf_dir, "PRIM_CONTRIBUTORY_CAUSE"))


def fatal_points_without_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatal points of a table that has neither date nor cause."""
    return ANALYSES["fatal_points"](_without(spark, sf_dir, "PRIM_CONTRIBUTORY_CAUSE", "CRASH_DATE"))


def report_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart series and a map layer as the report writes them, read back through its manifest: name and each row's values."""
    out = f"{sinks.scratch_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(crash_tables(spark, sf_dir), out, ("daily_counts", "hotspot_layer"))
    read = read_report(spark, out)
    series = read["daily_counts"].select(F.lit("daily_counts").alias("name"), F.concat_ws("|", "CRASH_DATE", "count").alias("row"))
    layer = read["hotspot_layer"]
    place = [F.format_string("%.3f", c) for c in ("lat", "lon")]
    return series.unionByName(layer.select(F.lit("hotspot_layer").alias("name"), F.concat_ws("|", *place, "radius", "color", "popup").alias("row")))


def crash_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of the crash-grain charts with its counts, from one scan."""
    counts = charts.crash_counts(CrashData(crash_tables(spark, sf_dir)).counted)
    names = [c for c in counts.columns if c not in ("dimension", "count", *charts.FLAGS)]
    value = F.coalesce(*[F.col(c).cast("string") for c in names])
    return counts.select("dimension", value.alias("value"), "count", *charts.FLAGS)


def driver_features_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver table from people, vehicles and crashes that are first stored by key."""
    tables = CrashData(crash_tables(spark, sf_dir)).tables
    store = write_keyed(tables, f"{sinks.scratch_dir(spark)}/keyed-{uuid.uuid4().hex}")
    return sinks.timestamps_as_text(drivers.driver_features(drivers.keyed_drivers(store, tables.fatalities), store.key))


def csv_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and broken lines of a CSV by their kind, with the fields and characters read from them."""
    out = f"{sinks.scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    columns = ["CRASH_RECORD_ID", "CRASH_DATE", "LATITUDE", "LONGITUDE"]
    number = F.col("CRASH_RECORD_ID").cast("long")
    whole = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in columns])
    line = F.when(number % 31 == 0, F.concat("CRASH_RECORD_ID", F.lit(",cut"))).when(number % 37 == 0, F.concat(whole, F.lit(",more"))).otherwise(whole)
    crash_tables(spark, sf_dir).crashes.select(line.alias("line")).write.text(f"{out}/csv")
    good, broken = split_csv(spark, f"{out}/csv", f"{out}/split", columns, header=False)
    fields = [F.count(F.lit(1)).alias("lines"), F.count("LATITUDE").alias("latitudes"), F.sum(F.length("CRASH_RECORD_ID")).alias("chars")]
    none = F.lit(0).cast("long").alias("latitudes")
    lost = broken.agg(F.count(F.lit(1)).alias("lines"), none, F.sum(F.length("line")).alias("chars"))
    return good.agg(*fields).select(F.lit("good").alias("kind"), "*").unionByName(lost.select(F.lit("broken").alias("kind"), "*"))


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial counts of a store whose last months were half filled and are then written anew."""
    path = f"{sinks.scratch_dir(spark)}/months-{uuid.uuid4().hex}"
    flagged = CrashData(crash_tables(spark, sf_dir)).flagged
    monthly.write_months(flagged.where("CRASH_DATETIME < timestamp_ntz'2001-06-15'"), path)
    monthly.write_months(flagged, path, ("2001-06", "2001-07", "2001-08"))
    return monthly.read_months(spark, path)


def daily_counts_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crashes by day from stored partial counts, after months were added."""
    return monthly.daily(_refreshed(spark, sf_dir))


def cell_counts_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated crashes by grid cell in 2001, from the folders of that year's months only."""
    return monthly.cells(_refreshed(spark, sf_dir).where("CRASH_MONTH >= '2001-01'"))


def fatal_hit_run_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatal crashes of heavy vehicles that a column marks as hit-and-run."""
    tables = crash_tables(spark, sf_dir)
    number = F.col("CRASH_RECORD_ID").cast("long")
    mark = F.when(number % 3 == 0, "Y").when(number % 3 == 1, " y ").when(number % 2 == 0, "N")
    marked = tables._replace(crashes=tables.crashes.withColumn("LEFT_SCENE", mark))
    return ANALYSES["fatal_vehicle_type_layer"](CrashData(marked, heavy_types=HEAVY_TYPES, hit_run=("LEFT_SCENE", ("Y",))))


def schema_tolerant_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return street.daily_outcomes(street.adapt(street_reports(spark, sf_dir)))


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables written as CSV, read back as text and counted by severity columns."""
    out = f"{sinks.scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables = crash_tables(spark, sf_dir)
    paths = {name: f"{out}/{name}" for name in Tables._fields}
    for name, df in tables._asdict().items():
        df.write.mode("overwrite").option("header", True).csv(paths[name])
    loaded = load_tables(spark, paths)
    whole = crash.combined(loaded)
    clean_path = f"{out}/clean"
    sinks.write_parquet(whole, clean_path)
    read = spark.read.parquet(clean_path)
    flagged = read.withColumn("injury_any", features.injury_any(severity_columns(read)))
    return flagged.groupBy("HOUR").agg(
        F.count(F.lit(1)).alias("crashes"),
        F.count_if("injury_any").alias("injured"),
        F.sum("persons").alias("persons"),
        F.sum("speeding_veh").alias("speeding_veh"),
    )
