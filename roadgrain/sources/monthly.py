"""Partial counts kept by month, so that new or corrected months are written without reading the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.functions.clean import month_name
from roadgrain.functions.features import with_grid_bin

MONTH = "CRASH_MONTH"
CAUSE = "PRIM_CONTRIBUTORY_CAUSE"
FLAGS = ("injured", "fatal")
STORED = f"CRASH_DATE date, lat_bin double, lon_bin double, {CAUSE} string, count long, injured long, fatal long, {MONTH} string"
#: Files of a month; its cells are dealt over so many tasks.
PARTS = 8


def partial_counts(flagged: DataFrame) -> DataFrame:
    """Dated crashes counted by month (``yyyy-MM``), day, grid cell and cause; cells and causes may be NULL.

    ``flagged`` are cleaned crashes with ``injury_any`` and ``is_fatal``. A missing cause column
    counts as a missing cause.
    """
    df = with_grid_bin(flagged.where(F.col("CRASH_DATETIME").isNotNull()))
    if CAUSE not in df.columns:
        df = df.withColumn(CAUSE, F.lit(None).cast("string"))
    keys = [F.to_date("CRASH_DATETIME").alias("CRASH_DATE"), "lat_bin", "lon_bin", CAUSE, month_name().alias(MONTH)]
    counts = [F.count(F.lit(1)).alias("count"), F.count_if("injury_any").alias("injured"), F.count_if("is_fatal").alias("fatal")]
    return df.groupBy(*keys).agg(*counts)


def write_months(flagged: DataFrame, path: str, months: Sequence[str] | None = None) -> None:
    """Count the crashes of ``months`` (``yyyy-MM``; all if None) and replace those months in the store.

    Other months are neither read nor written. A named month without crashes is emptied.
    """
    spark = flagged.sparkSession
    if months is not None:
        flagged = flagged.where(month_name().isin(*months))
    counts = partial_counts(flagged).select(*_names())
    if months:
        # A row without crashes names a month, so that its partition is replaced in any case.
        empty = spark.createDataFrame([(None, None, None, None, 0, 0, 0, m) for m in months], STORED)
        counts = counts.unionByName(empty)
    part = F.pmod(F.xxhash64("CRASH_DATE", "lat_bin", "lon_bin"), F.lit(PARTS))
    dealt = counts.repartition(MONTH, part).sortWithinPartitions(MONTH, "CRASH_DATE")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The partial counts; a filter on ``CRASH_MONTH`` reads those months' folders only."""
    return spark.read.schema(STORED).parquet(path).where("count > 0")


def daily(counts: DataFrame) -> DataFrame:
    """Crashes by day, with the injured and the fatal ones."""
    return counts.groupBy("CRASH_DATE").agg(*_sums())


def cells(counts: DataFrame) -> DataFrame:
    """Crashes by grid cell, with the injured and the fatal ones; crashes without a place are left out."""
    return counts.where("lat_bin is not null and lon_bin is not null").groupBy("lat_bin", "lon_bin").agg(*_sums())


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("count", *FLAGS)]


def _names() -> list[str]:
    return [field.split()[0] for field in STORED.split(", ")]
