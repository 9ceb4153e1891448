"""The whole job: every chart series and map layer of a set of crash tables, as Parquet."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from roadgrain.plans import crash
from roadgrain.plans.analyses import ANALYSES, CrashData
from roadgrain.plans.charts import CHARTS, crash_counts
from roadgrain.sources.sinks import materialise, write_parquet
from roadgrain.sources.tables import Tables

# Analyses that list every crash, person or driver; a caller who wants the charts and maps alone
# passes the others as ``names``.
ROW_LEVEL = (
    "crash_combined",
    "driver_features",
    "date_parts",
    "hour_year_from_text",
    "geo_clean",
    "clean_categories",
    "people_summary",
    "vehicles_summary",
    "injury_flags",
    "impact_scores",
    "drivers_joined",
    "fatal_ref_flag",
    "vehicle_mode",
    "crashes_as_json",
)


def write_report(tables: Tables, out_dir: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Write the named analyses (by default all) under ``out_dir``; all of them or none.

    The text tables and the cleaned crashes are written as Parquet once, so that each analysis
    reads just its columns instead of parsing the text again. Charts over all crashes come from one
    counted frame. An analysis whose columns the tables lack is left out with a warning.

    A run writes to a folder of its own and names it in the manifest last, which is one file written as
    a whole: readers see the last report that was finished. Returns the path per name.
    """
    run = f"{out_dir}/run-{uuid.uuid4().hex}"
    spark = tables.crashes.sparkSession
    named = CrashData(tables).tables._asdict()
    stored = Tables(*[materialise(df, f"{run}/tables/{n}") for n, df in named.items()])
    clean = materialise(crash.clean_crashes(stored.crashes), f"{run}/tables/clean_crashes")
    data = CrashData(stored, clean)
    names = list(names or ANALYSES)
    counts = None
    if sum(n in CHARTS for n in names) > 1:
        counts = materialise(crash_counts(data.counted), f"{run}/tables/crash_counts")
    paths = {}
    for name in names:
        try:
            if counts is not None and name in CHARTS and {CHARTS[name][0]} - {""} <= set(counts.columns):
                result = CHARTS[name][1](counts)
            else:
                result = ANALYSES[name](data)
        except AnalysisException as missing:
            if not str(missing.getCondition()).startswith("UNRESOLVED_COLUMN"):
                raise
            warnings.warn(f"{name} left out: {missing}", stacklevel=2)
            continue
        paths[name] = f"{run}/{name}"
        write_parquet(result, paths[name])
    written = spark.createDataFrame([(n, p) for n, p in paths.items()], "name string, path string")
    version = 1 + max((r["version"] for r in _manifests(spark, out_dir).select("version").distinct().collect()), default=0)
    written.coalesce(1).write.mode("errorifexists").parquet(f"{out_dir}/manifest/version={version}")
    return paths


def _manifests(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of all manifests; a manifest's one file appears when it is complete."""
    columns = "name string, path string, version int"
    try:
        return spark.read.schema(columns).parquet(f"{out_dir}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_report(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The results of the last finished report under ``out_dir``, by name."""
    listed = _manifests(spark, out_dir).collect()
    if not listed:
        raise FileNotFoundError(f"no finished report under {out_dir}")
    last = max(r["version"] for r in listed)
    return {r["name"]: spark.read.parquet(r["path"]) for r in listed if r["version"] == last}
