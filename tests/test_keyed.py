"""Tables stored by key give the same driver rows without a shuffle."""

from __future__ import annotations

import pytest

from roadgrain.functions.schema import CRASH_KEY as KEY
from roadgrain.operators import joins
from roadgrain.plans import catalog, drivers
from roadgrain.sources import keyed
from tests.test_operators import driver_tables, rows

KEEP = [KEY, "VEHICLE_ID", "VEHICLE_TYPE", "PERSON_TYPE", "age_bin", "surface", "HOUR", "fatal_outcome"]
SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("min_rows", [5, 10**9])
def test_keyed_rows_equal_joined_rows(spark, tmp_path, min_rows):
    tables = driver_tables(spark)
    store = keyed.write_keyed(tables, str(tmp_path), 3, min_rows)
    want = rows(drivers.joined_drivers(tables).select(*KEEP))
    assert rows(drivers.keyed_drivers(store).select(*KEEP)) == want
    again = keyed.open_keyed(spark.newSession(), str(tmp_path))
    assert again.key == KEY and rows(drivers.keyed_drivers(again).select(*KEEP)) == want


def test_a_hot_crash_is_dealt_over_buckets(spark, tmp_path):
    tables = driver_tables(spark)
    many = spark.range(3_000).selectExpr(f"'hot' as {KEY}", "cast(id % 2 as string) as VEHICLE_ID", "'DRIVER' as PERSON_TYPE", "'3' as AGE")
    many = many.selectExpr("*", "'il' as DRIVER_LICENSE_STATE")
    store = keyed.write_keyed(tables._replace(people=many), str(tmp_path), 16, 100)
    sizes = [r["count"] for r in store.people.groupBy(keyed.SLOT).count().collect()]
    assert sum(sizes) == 3_000 and max(sizes) < 400
    found = drivers.keyed_drivers(store)
    # Vehicle 1 has two rows, vehicle 0 none.
    assert found.count() == 1_500 * 2 + 1_500 and found.where("HOUR is null").isEmpty()


def test_joins_need_no_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = keyed.write_keyed(driver_tables(spark), str(tmp_path), 4)
        for found in (drivers.keyed_drivers(store), drivers.driver_features(drivers.keyed_drivers(store), KEY)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("FileScan") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_driver_features_scan_each_table_once_where_nothing_is_hot(spark):
    plan = catalog.queries()["driver_features"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "__parts" not in plan


def test_tables_without_ids_are_refused(spark, tmp_path):
    tables = driver_tables(spark)
    with pytest.raises(ValueError, match="vehicle id"):
        keyed.write_keyed(tables._replace(vehicles=tables.vehicles.drop("VEHICLE_ID")), str(tmp_path))


def test_more_rows_get_more_buckets(spark, tmp_path, monkeypatch):
    tables = driver_tables(spark)
    want = rows(drivers.keyed_drivers(keyed.write_keyed(tables, str(tmp_path / "few"))).select(*KEEP))
    monkeypatch.setattr(joins, "TASK_ROWS", 1)
    monkeypatch.setattr(joins, "FEW_PARTS", 0)
    n = tables.people.count() + tables.crashes.count()
    store = keyed.write_keyed(tables, str(tmp_path / "many"))
    buckets = spark.read.parquet(str(tmp_path / "many" / "layout")).first()["buckets"]
    assert buckets == max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert rows(drivers.keyed_drivers(store).select(*KEEP)) == want


def test_hot_keys_are_counted_once_before_the_tables_are_written(spark, tmp_path, monkeypatch):
    found = []
    monkeypatch.setattr(keyed, "hot_lists", lambda sides, least: found.append(len(sides)) or joins.hot_lists(sides, least))
    monkeypatch.setattr(joins, "hot_keys", lambda *_: pytest.fail("counted by key"))
    keyed.write_keyed(driver_tables(spark), str(tmp_path), 4)
    assert found == [2, 1]
