"""Crash tables stored by key, so that driver rows meet their vehicle and crash without a shuffle.

People, vehicles and crashes are bucketed by the crash key and a slot. A slot is a vehicle of the
crash; one with very many people is dealt over several, and people without a key are dealt too. Vehicles
are repeated for the slots of their vehicle, crashes for the slots that their people are in. So equal key
and slot mean equal crash and vehicle, every join is on just the bucket columns, and no bucket gets a hot
crash whole.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.functions.clean import present
from roadgrain.functions.schema import crash_key, upper_columns
from roadgrain.operators.joins import HOT_ROWS, NULL_PARTS, deal, hot_lists, join_hot, parts_for, vehicle_join_keys, with_parts
from roadgrain.sources.tables import Tables

SLOT = "__SLOT"  # in upper case, as headers are put into it


class Keyed(NamedTuple):
    """The stored tables, each with a slot beside the crash key."""

    people: DataFrame
    vehicles: DataFrame
    crashes: DataFrame
    key: str


def write_keyed(tables: Tables, path: str, buckets: int | None = None, min_rows: int = HOT_ROWS) -> Keyed:
    """Store people, vehicles and crashes under ``path`` in ``buckets`` (by default the shuffle partitions,
    or more where there are many rows). Rows and hot keys are counted once, before the tables are written.

    People and vehicles must have the crash key and a vehicle id. Vehicles without one and crashes
    without people match no driver and are left out.
    """
    crashes, people, vehicles = (upper_columns(df) for df in (tables.crashes, tables.people, tables.vehicles))
    spark, key = crashes.sparkSession, crash_key(crashes)
    keys = vehicle_join_keys(people, vehicles, key)
    if keys is None or key not in keys[0]:
        raise ValueError("people and vehicles need the crash key and a vehicle id")
    (_, person_id), vehicle_id = keys
    named = people.withColumn("__id", _id(person_id))
    (hot, hot_right), rows = hot_lists([(named, [key, "__id"]), (crashes, [key])], min_rows)
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(sum(rows)) or 0)
    if hot is None:
        hot = spark.createDataFrame([], named.select(key, "__id", F.lit(0).alias("__parts")).schema)
    dealt = with_parts(named, hot, [key, "__id"], "__parts")
    parts = F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    dealt = dealt.withColumn(SLOT, _slot(deal(dealt, parts, people.columns))).drop("__id", "__parts")
    people = _write(dealt, f"{path}/people", key, n)

    named = present(vehicles, key, vehicle_id).withColumn("__id", _id(vehicle_id))
    copied = with_parts(named, hot, [key, "__id"], "__parts")
    every = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    copied = copied.withColumn("__part", F.explode(every)).withColumn(SLOT, _slot(F.col("__part")))
    vehicles = _write(copied.drop("__id", "__parts", "__part", vehicle_id), f"{path}/vehicles", key, n)

    slots = present(people.select(key, SLOT), key).distinct()
    (hot_left,), _ = hot_lists([(slots, [key])], min_rows)
    met = join_hot(slots, crashes, [key], min_rows, how="inner", hot=(hot_left, hot_right), parts=parts_for(sum(rows)))
    crashes = _write(met, f"{path}/crashes", key, n)
    spark.createDataFrame([(key, n)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return Keyed(people, vehicles, crashes, key)


def open_keyed(spark: SparkSession, path: str) -> Keyed:
    """The tables that ``write_keyed`` stored under ``path``, also in another session."""
    key, n = spark.read.parquet(f"{path}/layout").first()
    return Keyed(*[_registered(spark, f"{path}/{name}", key, n) for name in ("people", "vehicles", "crashes")], key)


def _id(column: str) -> Column:
    return F.coalesce(F.concat(F.lit(":"), F.col(column).cast("string")), F.lit("!"))


def _slot(part: Column) -> Column:
    return F.concat(part.cast("string"), F.col("__id"))


def _write(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    # Dealt as the buckets are, each task writes one file.
    name = f"keyed_{uuid.uuid4().hex}"
    writer = df.repartition(n, key, SLOT).write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(n, key, SLOT).sortBy(key, SLOT).saveAsTable(name)
    return df.sparkSession.table(name)


def _registered(spark: SparkSession, path: str, key: str, n: int) -> DataFrame:
    name = f"keyed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = f"(`{key}`, `{SLOT}`)"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY {by} SORTED BY {by} INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)
