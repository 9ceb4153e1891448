"""Writers and bounded outputs."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with the frame as Parquet."""
    df.write.mode("overwrite").parquet(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write the frame as Parquet and read it back, which also cuts its lineage."""
    write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder of the cluster (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="roadgrain-")


def json_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON text per row, missing fields written as null."""
    fields = F.struct(*(columns or df.columns))
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def timestamps_as_text(df: DataFrame) -> DataFrame:
    """Cast every timestamp column to text."""
    kinds = (T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, kinds) else f.name
            for f in df.schema.fields
        ]
    )


def bounded(df: DataFrame, columns: Sequence[str], n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of ``columns`` in ``order``, timestamps as text."""
    return timestamps_as_text(df.orderBy(*order).limit(n).select(*columns))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows of the table, non-null and null values. One pass, one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    names = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in df.columns]
    )
    return (
        counts.select(F.col("__rows").alias("rows"), F.inline(names))
        .withColumn("nulls", F.col("rows") - F.col("non_null"))
        .select("column_name", "rows", "non_null", "nulls")
    )
