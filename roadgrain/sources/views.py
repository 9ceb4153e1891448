"""Crash-shaped tables derived from the ``orders``, ``lineitem`` and ``part`` test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgrain.functions.clean import computed_once
from roadgrain.operators.joins import in_parts, parts_for
from roadgrain.sources.tables import Tables


# Columns of the test tables that the views read.
SCHEMAS = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_returnflag string""",
    "part": "p_partkey bigint, p_brand string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its known schema, so that no job reads file footers first."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def crashes_view(orders: DataFrame) -> DataFrame:
    view = orders.selectExpr(
        "cast(o_orderkey as string) as CRASH_RECORD_ID",
        """case when o_orderkey % 97 = 0 then 'not a date' when o_orderkey % 89 = 0 then null
           else date_format(o_orderdate
             + make_dt_interval(0, 0, cast(o_orderkey * 37 % 1440 as int), 0),
             'MM/dd/yyyy hh:mm:ss a') end as CRASH_DATE""",
        """case when o_orderkey % 53 = 0 then null when o_orderkey % 59 = 0 then '0.0'
           else cast(cast(41.65 as double) + cast((o_orderkey % 40) * 10 as double) / 1000
             as string) end as LATITUDE""",
        """case when o_orderkey % 53 = 0 then null when o_orderkey % 61 = 0 then '0.0'
           else cast(cast(-87.9 as double) + cast((o_custkey % 20) * 20 as double) / 1000
             as string) end as LONGITUDE""",
        """case when o_orderkey % 41 = 0 then ' nan ' when o_orderkey % 43 = 0 then null
           else concat(' ', lower(o_orderpriority), ' ', cast(o_custkey % 6 as string), ' ')
           end as PRIM_CONTRIBUTORY_CAUSE""",
        """case when o_orderkey % 47 = 0 then 'None'
           else concat(o_orderstatus, cast(o_custkey % 5 as string)) end as WEATHER_CONDITION""",
        "concat('light ', cast(o_custkey % 11 as string)) as LIGHTING_CONDITION",
        "concat('tcd ', cast(o_custkey % 4 as string)) as TRAFFIC_CONTROL_DEVICE",
        "concat('surface ', cast(o_custkey % 13 as string)) as ROADWAY_SURFACE_COND",
        """case when o_orderkey % 103 = 0 then null when o_orderkey % 101 = 0 then '1'
           else '0' end as INJURIES_FATAL""",
        "case when o_orderkey % 17 = 0 then '1' else '0' end as INJURIES_INCAPACITATING",
        "case when o_orderkey % 5 = 0 then '2' else '0' end as INJURIES_NON_INCAPACITATING",
        """case when o_orderkey % 107 = 0 then 'nan' when o_orderkey % 109 = 0 then 'Infinity'
           when o_orderkey % 7 = 0 then '1' else '0' end as INJURIES_POSSIBLE""",
    )
    return computed_once(view)


def people_view(lineitem: DataFrame) -> DataFrame:
    view = lineitem.selectExpr(
        """concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',
             cast(l_partkey as string), '-', cast(l_suppkey as string)) as PERSON_ID""",
        "cast(l_orderkey as string) as CRASH_RECORD_ID",
        """case when l_returnflag = 'N' then null
           else cast(l_orderkey * 10 + l_linenumber as string) end as VEHICLE_ID""",
        """case l_linenumber % 5 when 0 then 'PASSENGER' when 1 then 'DRIVER'
           when 2 then ' driver ' when 3 then 'PEDESTRIAN' else 'BICYCLE' end as PERSON_TYPE""",
        """case when l_partkey % 19 = 0 then null when l_partkey % 37 = 0 then 'nan'
           else cast(l_partkey % 95 as string) end as AGE""",
        """case when l_suppkey % 23 = 0 then null
           else concat(' st', cast(l_suppkey % 13 as string)) end as DRIVER_LICENSE_STATE""",
    )
    return computed_once(view)


def vehicles_view(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    joined = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    # The count reads file footers only. Texts are aggregated by sorting, so a task's rows are bounded.
    joined = in_parts(joined, parts_for(lineitem.count()), "l_orderkey", "l_linenumber")
    grouped = joined.groupBy("l_orderkey", "l_linenumber").agg(
        {"p_brand": "min", "l_quantity": "min"}
    )
    return grouped.selectExpr(
        "cast(l_orderkey * 10 + l_linenumber as string) as VEHICLE_ID",
        "cast(l_orderkey as string) as CRASH_RECORD_ID",
        "`min(p_brand)` as VEHICLE_TYPE",
        """case when `min(l_quantity)` > 45 then 'SPEED TOO FAST' else 'OTHER' end
           as PRIM_CONTRIBUTORY_CAUSE""",
    )


def fatalities_view(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 101 = 0").selectExpr(
        "cast(o_orderkey as string) as CRASH_RECORD_ID"
    )


def crash_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The four crash tables over the Parquet files in ``sf_dir``."""
    orders, lineitem, part = (read_table(spark, sf_dir, name) for name in SCHEMAS)
    return Tables(
        crashes_view(orders),
        people_view(lineitem),
        vehicles_view(lineitem, part),
        fatalities_view(orders),
    )


def street_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with other headers: crash_id, ISO crash_date, injuries, fatalities, street."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as crash_id",
        """case when o_orderkey % 83 = 0 then 'unknown'
           else date_format(o_orderdate, 'yyyy-MM-dd') end as crash_date""",
        "case when o_orderkey % 71 = 0 then 'n/a' else cast(o_orderkey % 3 as string) end as injuries",
        "case when o_orderkey % 101 = 0 then '1' else '0' end as fatalities",
        "concat('Street ', cast(o_custkey % 50 as string)) as street",
    )
