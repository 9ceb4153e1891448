"""Readers: header-row CSV with every column as text, and the bundle of the four crash tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that holds a broken line as it stands in the file.
BROKEN = "__broken_line"


class Tables(NamedTuple):
    """The four crash tables."""

    crashes: DataFrame
    people: DataFrame
    vehicles: DataFrame
    fatalities: DataFrame


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header row, all columns text.

    Known ``columns`` save the header-reading job. They must be the header's names in its order;
    a file with another header raises when it is read, and is not relabelled.
    """
    reader = spark.read.option("header", True)
    if columns is not None:
        reader = reader.option("enforceSchema", False)
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def split_csv(spark: SparkSession, path: str, out: str, columns: list[str] | None = None, *, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV (all columns text) and, as a side table, its broken lines.

    A line is broken when it has more or fewer fields than the header, or than ``columns``, which a
    file without a header needs. The file is parsed once and kept in ``out``, apart by broken or
    not, so that either table reads its own folder only. The side table has one column, ``line``.
    """
    names = spark.read.option("header", True).csv(path).columns if columns is None else columns
    fields = [T.StructField(c, T.StringType()) for c in names]
    schema = T.StructType([*fields, T.StructField(BROKEN, T.StringType())])
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", not header)
    parsed = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path)
    parsed = parsed.withColumn("__is_broken", F.col(BROKEN).isNotNull())
    parsed.write.mode("overwrite").partitionBy("__is_broken").parquet(out)
    kept = spark.read.schema(schema.add("__is_broken", "boolean")).parquet(out)
    broken = F.col("__is_broken")
    return kept.where(~broken).select(*names), kept.where(broken).select(F.col(BROKEN).alias("line"))


def load_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv") -> Tables:
    """The four tables from ``paths``, keyed by table name; ``fmt`` is ``csv`` or ``parquet``."""
    read = (lambda p: read_csv_strings(spark, p)) if fmt == "csv" else spark.read.parquet
    return Tables(**{name: read(paths[name]) for name in Tables._fields})
