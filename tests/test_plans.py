"""The physical plans are the ones meant for large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadgrain.operators import joins
from roadgrain.plans import catalog, charts, crash, report
from roadgrain.plans.analyses import ANALYSES, CrashData
from roadgrain.sources.tables import Tables
from roadgrain.sources.views import crash_tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    names = [n for n in catalog.queries() if n not in ("csv_tables", "report_outputs")]
    return {n: plan(catalog.queries()[n](spark, SF_DIR)) for n in names}


def test_no_python_and_no_cross_product(plans):
    for name, text in plans.items():
        for bad in ("PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_top_k_is_not_a_full_sort(plans):
    for name in ("top_causes", "hotspots_top200", "cause_impact_top5", "fatal_rate_by_surface"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_aggregates_are_combined_before_the_shuffle(plans):
    for name in ("daily_counts", "hotspots_top200", "people_summary", "fatal_rate_by_age", "vehicle_mode"):
        assert "partial_" in plans[name], name


def test_hotspots_need_no_join_and_one_scan(plans):
    assert "Join" not in plans["hotspots_top200"]
    assert plans["hotspots_top200"].count("FileScan") == 1


def test_only_needed_columns_are_read(plans):
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plans["daily_counts"]


def test_no_sort_of_all_rows_in_capped_selection(plans):
    # The only single-partition steps follow the histogram and the cut.
    text = plans["heat_sample"]
    single = text.index("Exchange SinglePartition")
    assert "__h" in text[single:] and "partial_sum" in text[single:]


def test_cleaned_table_pushes_filters(spark, tmp_path):
    data = CrashData(crash_tables(spark, SF_DIR))
    paths = report.write_report(data.tables, str(tmp_path), ["hotspots_top200", "daily_counts"])
    assert spark.read.parquet(paths["hotspots_top200"]).count() == 200
    clean = spark.read.parquet(paths["daily_counts"].replace("/daily_counts", "/tables/clean_crashes"))
    text = plan(ANALYSES["hotspots_top200"](CrashData(data.tables, clean)))
    assert "IsNotNull(LAT), IsNotNull(LON)" in text
    assert "CRASH_DATE" not in text.split("ReadSchema")[1]
    assert ANALYSES["hotspots_top200"](data).count() == 200


def rows_per_task(df):
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("copies"))
    return [r.n for r in sizes.collect()]


def test_hot_and_missing_keys_are_spread_over_tasks(spark):
    """A third of the left rows share one key and a third have none: no task gets a third."""
    rows = [(("hot", None, f"k{i}")[i % 3], i) for i in range(9_000)]
    left = spark.createDataFrame(rows, "CRASH_RECORD_ID string, n int").repartition(16)
    right = left.groupBy("CRASH_RECORD_ID").agg(F.count(F.lit(1)).alias("copies"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, n in (("left", 9_000), ("inner", 6_000)):
            got = joins.join_hot(left, right, ["CRASH_RECORD_ID"], 500, right_unique=True, how=how)
            sizes = rows_per_task(got)
            assert sum(sizes) == n and max(sizes) < 0.3 * n
        assert max(rows_per_task(left.join(right, "CRASH_RECORD_ID", "left"))) > 3_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_summaries_are_merged_without_a_further_shuffle(plans):
    after = plans["crash_combined"].split("Union")[0]
    # Crashes and the merged counts are each sent to the join once; besides, the crashes' keys are
    # counted (one shuffle of partial counts) and the hot ones broadcast.
    assert after.count("Exchange hashpartitioning") + after.count("BroadcastExchange") <= 4
    assert after.count("keys=[CRASH_RECORD_ID") >= 2 and "partial_count(1)" in after


def test_report_writes_every_small_analysis(spark, tmp_path):
    tables = crash_tables(spark, SF_DIR)
    wanted = ["dow_counts", "top_causes", "fatal_rate_by_age", "hotspot_layer", "profile_crashes"]
    paths = report.write_report(Tables(*tables), str(tmp_path), wanted)
    direct = CrashData(tables)
    for name in wanted:
        got = sorted(map(repr, spark.read.parquet(paths[name]).collect()))
        assert got == sorted(map(repr, ANALYSES[name](direct).collect())), name


def test_charts_from_one_scan_equal_single_ones(spark):
    data = CrashData(crash_tables(spark, SF_DIR))
    counts = charts.crash_counts(data.counted)
    assert plan(counts).count("FileScan") == 1
    stored = counts.cache()
    for name, (_, chart) in charts.CHARTS.items():
        assert list(map(repr, chart(stored).collect())) == list(map(repr, ANALYSES[name](data).collect())), name
    stored.unpersist()


def test_report_takes_charts_from_the_counts(spark, tmp_path):
    tables = crash_tables(spark, SF_DIR)
    wanted = ["daily_counts", "injury_share", "topk_rate_surface", "hourly_fatal"]
    paths = report.write_report(tables, str(tmp_path), wanted)
    run = paths["daily_counts"].removesuffix("/daily_counts")
    assert spark.read.parquet(f"{run}/tables/crash_counts").where("dimension = ''").count() == 1
    found = report.read_report(spark, str(tmp_path))
    assert sorted(found) == sorted(wanted)
    for name, df in found.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, ANALYSES[name](CrashData(tables)).collect())), name


def test_a_failed_report_leaves_the_last_one(spark, tmp_path, monkeypatch):
    tables, out = crash_tables(spark, SF_DIR), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        report.read_report(spark, out)
    report.write_report(tables, out, ["dow_counts"])
    broken = lambda d: d.clean.selectExpr("raise_error('broken') as x")
    monkeypatch.setitem(ANALYSES, "profile_crashes", broken)
    with pytest.raises(Exception, match="broken"):
        report.write_report(tables, out, ["dow_counts", "profile_crashes"])
    assert list(report.read_report(spark, out)) == ["dow_counts"]
    monkeypatch.undo()
    report.write_report(tables, out, ["dow_counts", "profile_crashes"])
    assert sorted(report.read_report(spark, out)) == ["dow_counts", "profile_crashes"]


def test_layers_read_their_source_twice_at_most(spark):
    for name, most in (("period_heat", 2), ("top_cause_layers", 2), ("fatal_by_age_layers", 6), ("fatal_by_surface_layers", 6)):
        df = catalog.queries()[name](spark, SF_DIR)
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
        assert 0 < final.count("FileScan") <= most, name  # of drivers, three tables make the source


def test_report_on_lower_case_headers_with_missing_columns(spark, tmp_path):
    t = crash_tables(spark, SF_DIR)
    lower = [df.toDF(*[c.lower().replace("crash_record_id", "rd_no") for c in df.columns]) for df in t]
    lower[0] = lower[0].drop("weather_condition")
    wanted = ["top_causes", "injury_rate_by_weather", "fatal_rate_by_age", "fatal_rate_by_vehicle_mode"]
    with pytest.warns(UserWarning, match="injury_rate_by_weather left out"):
        paths = report.write_report(Tables(*lower), str(tmp_path), wanted)
    assert sorted(paths) == ["fatal_rate_by_age", "fatal_rate_by_vehicle_mode", "top_causes"]
    for name, path in paths.items():
        got = sorted(map(repr, spark.read.parquet(path).collect()))
        assert got == sorted(map(repr, ANALYSES[name](CrashData(t)).collect())), name


def test_flags_use_the_list_of_fatalities_only_without_a_count(spark):
    tables = crash_tables(spark, SF_DIR)
    text = plan(crash.with_flags(crash.clean_crashes(tables.crashes), tables.fatalities))
    assert "Join" not in text
