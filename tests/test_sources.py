"""Readers, writers and bounded outputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from roadgrain.sources import monthly, sinks
from roadgrain.sources.tables import load_tables, read_csv_strings, split_csv


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_all_text_and_blank_is_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,date,n\n1,2025-09-01,2\n2,,""\n')
    for df in (read_csv_strings(spark, path), read_csv_strings(spark, path, ["id", "date", "n"])):
        assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
        assert [tuple(r) for r in df.collect()] == [("1", "2025-09-01", "2"), ("2", None, None)]


def test_load_tables_and_materialise(spark, tmp_path):
    paths = {n: write(tmp_path / f"{n}.csv", f"crash_record_id,{n}\na,1\n") for n in ("crashes", "people", "vehicles", "fatalities")}
    tables = load_tables(spark, paths)
    assert tables.people.columns == ["crash_record_id", "people"]
    out = str(tmp_path / "out")
    assert sinks.materialise(tables.crashes, out).collect() == tables.crashes.collect()
    again = load_tables(spark, dict.fromkeys(paths, out), "parquet")
    assert again.vehicles.columns == ["crash_record_id", "crashes"]


def test_json_bounded_profile(spark):
    df = spark.createDataFrame([("b", None), ("a", "2024-01-01 01:02:03")], "k string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    docs = [json.loads(r.json) for r in sinks.json_rows(df, ["k"]).collect()]
    assert docs == [{"k": "b"}, {"k": "a"}]
    assert [tuple(r) for r in sinks.bounded(df, ["k", "t"], 1, ["k"]).collect()] == [("a", "2024-01-01 01:02:03")]
    assert [tuple(r) for r in sinks.profile(df).collect()] == [("k", 2, 2, 0), ("t", 2, 1, 1)]
    assert [tuple(r) for r in sinks.profile(df.limit(0)).collect()] == [("k", 0, 0, 0), ("t", 0, 0, 0)]


def test_scratch_dir_follows_the_session(spark):
    assert sinks.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_dir_refuses_a_machine_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError):
        sinks.scratch_dir(Session())


def test_known_columns_do_not_relabel_a_file(spark, tmp_path):
    path = tmp_path / "crashes.csv"
    path.write_text("crash_id,crash_date\n1,2024-01-01\n")
    assert read_csv_strings(spark, str(path), ["crash_id", "crash_date"]).first().crash_date == "2024-01-01"
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_strings(spark, str(path), ["crash_date", "crash_id"]).collect()


def test_broken_lines_go_to_a_side_table(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,date,n\n1,2025-09-01,2\n2,cut\n3,a,b,more\n4,,\n5,"a,b",c\n')
    for columns in (None, ["id", "date", "n"]):
        good, broken = split_csv(spark, path, str(tmp_path / "split"), columns)
        assert good.columns == ["id", "date", "n"]
        assert sorted(tuple(r) for r in good.collect()) == [("1", "2025-09-01", "2"), ("4", None, None), ("5", "a,b", "c")]
        assert sorted(r.line for r in broken.collect()) == ["2,cut", "3,a,b,more"]
        assert good.count() == 3 and broken.count() == 2


def flagged_crashes(spark, rows):
    df = spark.createDataFrame(rows, "day string, LAT double, LON double, injury_any boolean, is_fatal boolean")
    return df.withColumn("CRASH_DATETIME", F.col("day").cast("timestamp"))


def test_only_named_months_are_written(spark, tmp_path):
    path = str(tmp_path / "months")
    rows = [("2024-01-05 10:00:00", 41.9, -87.6, True, False), ("2024-02-01 00:00:00", 41.9, -87.6, None, False), ("2024-03-01 00:00:00", None, None, True, True), (None, 41.9, -87.6, True, True)]
    monthly.write_months(flagged_crashes(spark, rows), path)
    files = lambda month: sorted((tmp_path / "months" / f"CRASH_MONTH={month}").glob("*.parquet"))
    before = {m: files(m) for m in ("2024-01", "2024-02", "2024-03")}
    # February gets a crash, March loses its only one, January is left out of the second run.
    more = [rows[1], ("2024-02-29 23:59:00", 41.9, -87.6, True, True)]
    monthly.write_months(flagged_crashes(spark, more), path, ["2024-02", "2024-03"])
    counts = monthly.read_months(spark, path)
    assert files("2024-01") == before["2024-01"] and files("2024-02") != before["2024-02"]
    days = sorted((str(r.CRASH_DATE), r["count"], r.injured, r.fatal) for r in monthly.daily(counts).collect())
    assert days == [("2024-01-05", 1, 1, 0), ("2024-02-01", 1, 0, 0), ("2024-02-29", 1, 1, 1)]
    assert [tuple(r) for r in monthly.cells(counts).collect()] == [(41.9, -87.6, 3, 2, 1)]
    plan = counts.where("CRASH_MONTH = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(CRASH_MONTH" in plan


def test_no_crashes_give_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "months")
    monthly.write_months(flagged_crashes(spark, []), path, ["2024-01"])
    assert monthly.daily(monthly.read_months(spark, path)).count() == 0
