"""Equi-joins of the crash tables, written so that one hot key cannot fill one task.

Adaptive execution splits a skewed partition only where both sides of a sort-merge join come
straight from a shuffle. Most joins here have an aggregate on one side, so hot keys are salted in
the plan, or rows are counted per key before they are sent to the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgrain.functions.clean import normalised, present
from roadgrain.functions.schema import (
    VEHICLE_ID_NAMES,
    crash_key,
    prefix_clashes,
    resolve_in_frame_order,
)
from roadgrain.operators.aggregates import PEOPLE_COUNTS, VEHICLE_COUNTS

# Rows that make a key hot, keys that are salted at most, and parts that rows without a key go to.
HOT_ROWS = 1_000_000
MOST_HOT = 100_000
NULL_PARTS = 1_024
# Rows that a task of a large join gets, tasks up to which Spark's own number is left, and hash buckets
# in which keys are counted first.
TASK_ROWS = 1_000_000
FEW_PARTS = 8
BUCKETS = 1 << 18


def hot_keys(df: DataFrame, on: Sequence[str], min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows and in how many parts to deal them (``on``, ``__parts``).

    Counted exactly, with map-side partial counts. There are as many as rows / ``min_rows`` at most;
    of more than ``MOST_HOT`` the largest are taken, so that the list can be broadcast.
    """
    counts = present(df.select(*on), *on).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > min_rows).orderBy(F.desc("__n"), *on).limit(MOST_HOT)
    return hot.select(*on, F.ceil(F.col("__n") / min_rows).cast("int").alias("__parts"))


def hot_lists(
    sides: Sequence[tuple[DataFrame, Sequence[str]]], min_rows: int = HOT_ROWS
) -> tuple[list[DataFrame | None], list[int]]:
    """The hot keys of each (frame, key columns), None where there are none, and the rows of each frame.

    For plans that join several large tables: they learn before they are built that (as nearly always)
    nothing needs salting. Rows are counted by hash bucket of their key, so that no task holds a count for
    each key; keys are counted only in buckets with more than ``min_rows`` rows, which all hot keys are in.
    A list has at most rows / ``min_rows`` keys, and ``MOST_HOT`` at most.
    """
    placed = [df.select(*on).withColumn("__bucket", _bucket(on)) for df, on in sides]
    by_bucket = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("side"), F.col("__bucket").alias("bucket")) for i, df in enumerate(placed)])
    full = F.when((F.col("n") > min_rows) & (F.col("bucket") >= 0), F.col("bucket"))
    counted = by_bucket.groupBy("side", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counted = {r["side"]: r for r in counted.groupBy("side").agg(F.sum("n").alias("rows"), F.collect_list(full).alias("full")).collect()}
    rows = [counted[i]["rows"] if i in counted else 0 for i in range(len(sides))]
    keys = []
    for i, (_, on) in enumerate(sides):
        if i in counted and counted[i]["full"]:
            own = hot_keys(placed[i].where(F.col("__bucket").isin(counted[i]["full"])), on, min_rows)
            keys.append(own.select(F.lit(i).alias("side"), F.array(*[F.col(c).cast("string") for c in on]).alias("key"), "__parts"))
    found = reduce(DataFrame.unionByName, keys).collect() if keys else []
    lists = []
    for i, (df, on) in enumerate(sides):
        own = [(r["key"], r["__parts"]) for r in found if r["side"] == i]
        typed = [F.col("key")[j].cast(df.schema[c].dataType).alias(c) for j, c in enumerate(on)]
        lists.append(df.sparkSession.createDataFrame(own, "key array<string>, __parts int").select(*typed, "__parts") if own else None)
    return lists, rows


def _bucket(on: Sequence[str]) -> Column:
    """A hash bucket of the key, -1 for one with a NULL part."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    return F.when(missing, -1).otherwise(F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int"))


def parts_for(rows: int) -> int | None:
    """Tasks for so many rows, so that one task's share does not grow with them; None for few rows."""
    parts = -(-rows // TASK_ROWS)
    return parts if parts > FEW_PARTS else None


def in_parts(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """``df`` dealt over ``parts`` tasks by ``columns``; as it is without a number."""
    return df if parts is None else df.repartition(parts, *columns)


def with_parts(df: DataFrame, hot: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Rows with the parts of their key: NULL for a key that is not hot."""
    return df.join(F.broadcast(hot.withColumnRenamed("__parts", name)), list(on), "left")


def deal(df: DataFrame, parts: Column, columns: Sequence[str]) -> Column:
    """A part for each row, the same when a lost task is run again: by the row's values and its task."""
    plain = [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), parts).cast("int")


def join_hot(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    min_rows: int = HOT_ROWS,
    right_unique: bool = False,
    keys_from: DataFrame | None = None,
    how: str = "left",
    hot: tuple[DataFrame | None, DataFrame | None] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` in which hot and NULL keys are spread over many tasks.

    ``how`` is ``left`` or ``inner``.

    A key with more than ``min_rows`` rows on the left is dealt out in parts of about that many, and
    its right rows are repeated once per part; a key hot on the right is treated the other way
    round. A NULL key matches nothing, so its rows go anywhere. ``right_unique`` promises one right
    row per key and saves the count of that side. ``keys_from`` is a cheaper frame than ``left`` to
    count its keys in, say the table that ``left`` was joined from. ``hot`` has the hot keys of both
    sides, listed before (see :func:`hot_lists`); None in it means that there are none. ``parts`` is the
    number of tasks to join in (see :func:`parts_for`), by default Spark's own.
    """
    one = F.array(F.lit(0))
    every = lambda parts: F.coalesce(F.sequence(F.lit(0), F.col(parts) - 1), one)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    sides = ["__salt_l"] if right_unique else ["__salt_l", "__salt_r"]

    hot_left, hot_right = hot or (hot_keys(left if keys_from is None else keys_from, on, min_rows), None)
    if hot and hot_left is None and hot_right is None:
        spread = F.when(missing, deal(left, F.lit(NULL_PARTS), left.columns)).otherwise(0)
        # Not a literal: the optimizer would take it out of the join keys, and NULL keys would meet in one task.
        zero = F.pmod(F.spark_partition_id(), F.lit(1))
        dealt, plain = left.withColumn("__salt_l", spread), present(right, *on).withColumn("__salt_l", zero)
        by = [*on, "__salt_l"]
        return in_parts(dealt, parts, *by).join(in_parts(plain, parts, *by), by, how).drop("__salt_l")
    if hot:
        none = left.sparkSession.createDataFrame([], right.select(*on).withColumn("__parts", F.lit(0)).schema)
        hot_left, hot_right = (none if h is None else h for h in (hot_left, hot_right))
    dealt = with_parts(left, hot_left, on, "__l")
    spread = F.when(missing, F.lit(NULL_PARTS)).otherwise(F.coalesce("__l", F.lit(1)))
    dealt = dealt.withColumn("__salt_l", deal(dealt, spread, left.columns))
    # Rows with a NULL key part match nothing.
    copied = with_parts(present(right, *on), hot_left, on, "__l").withColumn("__salt_l", F.explode(every("__l")))
    dealt, copied = dealt.drop("__l"), copied.drop("__l")
    if right_unique:
        return in_parts(dealt, parts, *on, *sides).join(in_parts(copied, parts, *on, *sides), [*on, *sides], how).drop(*sides)

    hot_right = hot_keys(right, on, min_rows) if hot_right is None else hot_right
    dealt = with_parts(dealt, hot_right, on, "__r").withColumn("__copied", F.col("__r").isNotNull())
    dealt = dealt.withColumn("__salt_r", F.explode(every("__r"))).drop("__r")
    copied = with_parts(copied, hot_right, on, "__r")
    copied = copied.withColumn("__salt_r", deal(copied, F.coalesce("__r", F.lit(1)), right.columns))
    copied = copied.drop("__r").withColumn("__hit", F.lit(True))
    joined = in_parts(dealt, parts, *on, *sides).join(in_parts(copied, parts, *on, *sides), [*on, *sides], how)
    # A copied left row has a partner in some part, as its key was counted on the right; a copy
    # without one is no row of the result, unless its key is without any partner there.
    return joined.where(~F.col("__copied") | F.col("__hit").isNotNull()).drop(*sides, "__copied", "__hit")


def child_counts(people: DataFrame | None, vehicles: DataFrame | None, key: str) -> DataFrame:
    """Merge the per-crash summaries of people and vehicles into one row per crash.

    Counts of a child table without rows for the crash stay NULL. Both summaries are hashed by
    the key already, which the union keeps, so that grouping them needs no further shuffle and
    the crashes are joined once.
    """
    names = [*PEOPLE_COUNTS, *VEHICLE_COUNTS]
    parts = [p for p in (people, vehicles) if p is not None]
    typed = [
        p.select(key, *[F.col(c) if c in p.columns else F.lit(None).cast("long").alias(c) for c in names])
        for p in parts
    ]
    return reduce(DataFrame.unionByName, typed).groupBy(key).agg(*[F.max(c).alias(c) for c in names])


def attach_summaries(
    crashes: DataFrame,
    people_sum: DataFrame,
    vehicles_sum: DataFrame,
    key: str | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Crashes with their people and vehicle counts; a crash without children has NULL counts."""
    key = key or crash_key(crashes)
    counts = child_counts(people_sum, vehicles_sum, key)
    return join_hot(crashes, counts, [key], min_rows, right_unique=True)


def drivers(people: DataFrame) -> DataFrame:
    """People whose type is DRIVER, whatever the case and blanks; everyone without that column."""
    if "PERSON_TYPE" not in people.columns:
        return people
    return people.where(normalised("PERSON_TYPE") == "DRIVER")


def vehicle_join_keys(people: DataFrame, vehicles: DataFrame, key: str) -> tuple[list[str], str] | None:
    """Join columns as named in people, and the vehicle id's name in vehicles; None without ids."""
    person_id = resolve_in_frame_order(people, VEHICLE_ID_NAMES)
    vehicle_id = resolve_in_frame_order(vehicles, VEHICLE_ID_NAMES)
    if person_id is None or vehicle_id is None:
        return None
    both = key in people.columns and key in vehicles.columns
    return ([key, person_id] if both else [person_id]), vehicle_id


def drivers_with_vehicles(
    people: DataFrame,
    vehicles: DataFrame,
    key: str,
    min_rows: int = HOT_ROWS,
    hot: tuple[DataFrame | None, DataFrame | None] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """People with their vehicle on (crash, vehicle id); one row per person and matching vehicle."""
    keys = vehicle_join_keys(people, vehicles, key)
    if keys is None:
        return people
    on, vehicle_id = keys
    right = vehicles.withColumnRenamed(vehicle_id, on[-1])
    return join_hot(people, prefix_clashes(right, people, on, "VEH_"), on, min_rows, hot=hot, parts=parts)


def drivers_with_crashes(
    pv: DataFrame,
    crashes: DataFrame,
    key: str,
    min_rows: int = HOT_ROWS,
    keys_from: DataFrame | None = None,
    hot: tuple[DataFrame | None, DataFrame | None] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Driver rows with their crash: driver grain, a crash counts once per driver."""
    if key not in pv.columns or key not in crashes.columns:
        return pv
    right = prefix_clashes(crashes, pv, [key], "CRASH_")
    return join_hot(pv, right, [key], min_rows, keys_from=keys_from, hot=hot, parts=parts)


def flag_members(
    df: DataFrame, ids: DataFrame, key: str, name: str, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name``: whether the row's key is among the ids. No id passes through the driver."""
    members = present(ids.select(key), key).distinct().withColumn("__member", F.lit(True))
    joined = join_hot(df, members, [key], min_rows, right_unique=True)
    return joined.withColumn(name, F.col("__member").isNotNull()).drop("__member")


def driver_groups(
    people: DataFrame,
    vehicles: DataFrame,
    crashes: DataFrame,
    key: str,
    person_dims: Sequence[str] = (),
    crash_dims: Sequence[str] = (),
    matched_only: bool = False,
) -> DataFrame:
    """Driver-grain rows counted by ``person_dims`` and ``crash_dims``.

    Same counts as grouping the joined rows (drivers, their vehicles, their crash), but each
    table is counted per crash before any row is sent to a join, so a crash that holds a third
    of the people reaches it as a handful of counted rows. ``matched_only`` leaves out drivers
    without a crash, for callers that need its columns.

    Columns: the dimensions, ``drivers`` and, of these, ``fatal_drivers``.
    """
    keys = vehicle_join_keys(people, vehicles, key)
    ids = [c for c in (keys[0] if keys else []) if c != key]
    counted = people.groupBy(key, *ids, *person_dims).agg(F.count(F.lit(1)).alias("__n"))
    if keys is not None:
        # A person is repeated only where the vehicle is: usually an empty table.
        on, vehicle_id = keys
        repeated = (
            present(vehicles.withColumnRenamed(vehicle_id, on[-1]), *on)
            .groupBy(*on)
            .agg(F.count(F.lit(1)).alias("__copies"))
            .where(F.col("__copies") > 1)
        )
        if key in on:
            counted = counted.join(repeated, on, "left")
        else:
            # The id alone may be missing or shared in many crashes.
            counted = join_hot(counted, repeated, on, right_unique=True)
        counted = counted.withColumn("__n", F.col("__n") * F.coalesce("__copies", F.lit(1)))
    by_crash = counted.groupBy(key, *person_dims).agg(F.sum("__n").alias("__n"))
    facts = crashes.groupBy(key, *crash_dims).agg(
        F.count(F.lit(1)).alias("__m"), F.count_if("fatal_outcome").alias("__f")
    )
    joined = by_crash.join(facts, key, "inner" if matched_only else "left")
    return joined.select(
        *person_dims,
        *crash_dims,
        (F.col("__n") * F.coalesce("__m", F.lit(1))).alias("drivers"),
        (F.col("__n") * F.coalesce("__f", F.lit(0))).alias("fatal_drivers"),
    )
