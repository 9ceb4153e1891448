"""Cleaning and feature expressions on small literal frames, under ANSI mode."""

from __future__ import annotations

from datetime import datetime

import pytest

from roadgrain.functions import clean, features, schema
from roadgrain.operators import aggregates as agg
from roadgrain.plans import crash


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def evaluate(spark, values, expr, kind="string"):
    df = column(spark, values, kind).select("i", expr.alias("r")).orderBy("i")
    return [r.r for r in df.collect()]


def test_ansi_mode_is_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_resolution_rules(spark):
    df = spark.createDataFrame([], "LON string, X_COORDINATE string, VEH_ID string, VEHICLE_ID string")
    assert schema.resolve_preferred(df, schema.LON_NAMES) == "X_COORDINATE"
    assert schema.resolve_in_frame_order(df, schema.VEHICLE_ID_NAMES) == "VEH_ID"
    assert schema.resolve_preferred(df, ["NOPE"]) is None
    assert schema.crash_key(df) == "LON"
    other = spark.createDataFrame([], "A string, MY_CRASH_NO string")
    assert schema.resolve_in_frame_order(other, ["X"], contains="CRASH") == "MY_CRASH_NO"


def test_sample_shaped_headers(spark):
    rows = [("1", "2025-09-01", "0", "0", "Main St"), ("3", "2025-09-02", "0", "1", "2nd Ave")]
    df = schema.upper_columns(
        spark.createDataFrame(rows, "crash_id string, crash_date string, injuries string, fatalities string, street string")
    )
    assert schema.crash_key(df) == "CRASH_ID"
    assert schema.severity_columns(df) == ["INJURIES"]
    assert schema.fatal_column(df) == "FATALITIES"
    got = clean.with_datetime(df).select("CRASH_DATETIME").collect()
    assert [r[0] for r in got] == [datetime(2025, 9, 1), datetime(2025, 9, 2)]


def test_default_column_and_clashes(spark):
    df = spark.createDataFrame([("a", "b")], "K string, V string")
    assert schema.default_column(df, "V", "x") is df
    assert schema.default_column(df, "W", 0).first().W == 0
    right = spark.createDataFrame([("a", "c", "d")], "K string, V string, Z string")
    assert schema.prefix_clashes(right, df, ["K"], "R_").columns == ["K", "R_V", "Z"]


def test_parse_ts(spark):
    texts = ["09/01/2025 11:30:00 PM", "09/01/2025 12:00:00 AM", "2025-09-01", "junk", "", None, "13/45/2025 01:00:00 AM"]
    assert evaluate(spark, texts, clean.parse_ts("c")) == [
        datetime(2025, 9, 1, 23, 30), datetime(2025, 9, 1), datetime(2025, 9, 1), None, None, None, None,
    ]


def test_date_parts_and_day_name(spark):
    df = column(spark, [datetime(2025, 9, 7, 5), None], "timestamp").withColumnRenamed("c", "CRASH_DATETIME")
    rows = clean.date_parts(df).withColumn("d", clean.day_name()).orderBy("i").collect()
    assert (rows[0].YEAR, rows[0].MONTH, rows[0].DAY_OF_WEEK_NUM, rows[0].HOUR, rows[0].d) == (2025, 9, 1, 5, "Sunday")
    assert (rows[1].YEAR, rows[1].d) == (None, "Unknown")


def test_hour_and_year_from_text(spark):
    texts = ["01/01/2025 12:05:00 AM", "01/01/2025 12:05:00 PM", "01/01/2025 01:05:00 PM", "2025-01-01 17:05:00", "none", None]
    assert evaluate(spark, texts, clean.hour_from_text("c")) == [0, 12, 13, 17, None, None]
    assert evaluate(spark, texts, clean.year_from_text("c")) == [2025, 2025, 2025, 2025, None, None]


def test_category(spark):
    texts = [" nan ", "None", " wet road", "", None]
    assert evaluate(spark, texts, clean.category("c")) == [None, None, "WET ROAD", "", None]
    assert evaluate(spark, texts, clean.category("c", ())) == ["NAN", "NONE", "WET ROAD", "", None]


def test_geo_null_out(spark):
    rows = [
        ("41.60", "-88.0"), ("42.10", "-87.3"), ("50.0", "-87.6"), ("41.9", "-90"), ("41.59", "-87.6"),
        (None, "-87.6"), (None, "-90"), ("x", "-87.6"),
    ]
    df = clean.geo_null_out(clean.with_lat_lon(spark.createDataFrame(rows, "LATITUDE string, LONGITUDE string")))
    assert [(r.LAT, r.LON) for r in df.collect()] == [
        (41.6, -88.0), (42.1, -87.3), (None, None), (None, None), (None, None),
        (None, -87.6), (None, None), (None, -87.6),
    ]


def test_lat_lon_without_coordinates(spark):
    df = spark.createDataFrame([("1",)], "K string")
    assert clean.geo_null_out(clean.with_lat_lon(df)).columns == ["K"]


def test_injury_any_is_three_valued(spark):
    rows = [("0", "0"), ("1", None), ("0", None), (None, None), ("0.5", "0"), ("bad", "0"), ("bad", "2")]
    df = spark.createDataFrame(rows, "A string, B string")
    got = [r[0] for r in df.select(features.injury_any(["A", "B"])).collect()]
    assert got == [False, True, None, None, True, None, True]
    assert df.select(features.injury_any([])).first()[0] is False


def test_fatal_flag(spark):
    assert evaluate(spark, ["1", "0", None, "bad", "0.5"], features.fatal_flag("c")) == [True, False, False, False, True]
    assert evaluate(spark, ["1"], features.fatal_flag(None)) == [False]


def test_period(spark):
    hours = [5, 6, 19, 20, None]
    assert evaluate(spark, hours, features.period("c"), "int") == ["NIGHT", "DAY", "DAY", "NIGHT", "NIGHT"]


def test_grid_bin_rounds_half_up(spark):
    df = spark.createDataFrame([(41.8805, -87.6305), (41.88049, -87.63049)], "LAT double, LON double")
    rows = features.with_grid_bin(df).collect()
    assert [(r.lat_bin, r.lon_bin) for r in rows] == [(41.881, -87.631), (41.88, -87.63)]


def test_age_bin(spark):
    ages = ["15", "16", "24", "24.5", "25", "34", "35", "49", "50", "64", "64.5", "65", "-1", None, "x"]
    assert evaluate(spark, ages, features.age_bin("c")) == [
        "<16", "16-24", "16-24", "UNKNOWN", "25-34", "25-34", "35-49", "35-49", "50-64", "50-64",
        "UNKNOWN", "65+", "<16", "UNKNOWN", "UNKNOWN",
    ]
    assert evaluate(spark, ["40"], features.age_bin(None)) == ["UNKNOWN"]


def test_impact_score(spark):
    rows = [("1", "1", "1", "1"), ("0", "2", "0", "3"), (None, "1", "0", "0")]
    df = spark.createDataFrame(
        rows,
        "INJURIES_FATAL string, INJURIES_INCAPACITATING string, INJURIES_NON_INCAPACITATING string, INJURIES_POSSIBLE string",
    )
    assert [r.impact_score for r in features.with_impact(df).collect()] == [18.0, 13.0, None]
    part = features.with_impact(df.select("INJURIES_FATAL", "INJURIES_POSSIBLE"))
    assert [r.impact_score for r in part.collect()] == [11.0, 3.0, None]


def test_safe_rate(spark):
    df = spark.createDataFrame([(1, 4), (3, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(features.safe_rate("a", "b")).collect()] == [0.25, 0.0]


def test_hours_out_of_range_and_odd_halves(spark):
    texts = ["13:00:00 PM", "13:00:00 AM", "99:10:10", "24:00:00", "23:59:59", "12:00:00 AM", "12:00:00 PM"]
    assert evaluate(spark, texts, clean.hour_from_text("c")) == [13, 1, None, None, 23, 0, 12]


def test_text_without_a_date_is_no_timestamp(spark):
    texts = ["11:30:00", "T11:30", "2024-02-03 11:30:00", "2024-02-03", "2024", " 2024-02-03"]
    got = evaluate(spark, texts, clean.parse_ts("c").cast("string"))
    assert got[:2] == [None, None] and all(g is not None and g.startswith("2024-") for g in got[2:])


def test_only_finite_text_is_a_number(spark):
    assert evaluate(spark, ["1.5", "nan", "Infinity", "-Infinity", "x", None], clean.as_number("c")) == [1.5] + [None] * 5


WALL_TIMES = [
    ("03/10/2024 02:30:00 AM", "2024-03-10 02:30:00"),  # skipped in Chicago
    ("11/03/2024 01:30:00 AM", "2024-11-03 01:30:00"),  # comes twice there
    ("2024-03-10T02:30:00.25", "2024-03-10 02:30:00.25"),
    ("2024-03-10 02:30:00+02:00", "2024-03-10 00:30:00"),
    ("2024-03-10T02:30:00Z", "2024-03-10 02:30:00"),
    (" 2024-03-10", "2024-03-10 00:00:00"),
    ("2024", "2024-01-01 00:00:00"),
    ("13/40/2024 02:30:00 AM", None),
    ("", None),
    (None, None),
]


@pytest.fixture(params=["UTC", "America/Chicago", "Asia/Amman"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_do_not_depend_on_the_session(spark, zone):
    texts = [t for t, _ in WALL_TIMES]
    assert evaluate(spark, texts, clean.parse_ts("c").cast("string")) == [want for _, want in WALL_TIMES]
    df = column(spark, texts, "string").select(clean.parse_ts("c").alias("CRASH_DATETIME"))
    got = clean.date_parts(df).select("HOUR", "DAY_OF_WEEK_NUM", clean.day_name(), clean.month_name()).collect()
    assert [tuple(r) for r in got[:4]] == [(2, 1, "Sunday", "2024-03"), (1, 1, "Sunday", "2024-11"), (2, 1, "Sunday", "2024-03"), (0, 1, "Sunday", "2024-03")]
    assert tuple(got[-1]) == (None, None, "Unknown", None)


def test_typed_columns_and_zoned_patterns_are_read(spark, zone):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00' as c, date'2005-04-01' as d, '10.03.2024 02:30 +0200' as z")
    got = df.select(
        clean.parse_ts("c").cast("string"), clean.parse_ts("d").cast("string"), clean.parse_ts("z", ["dd.MM.yyyy HH:mm XX"]).cast("string"), clean.month_start("d").cast("string")
    ).first()
    assert tuple(got) == ("2024-03-10 02:30:00", "2005-04-01 00:00:00", "2024-03-10 00:30:00", "2005-04-01 00:00:00")


def test_crash_charts_are_the_same_in_every_zone(spark, zone):
    rows = [(str(i), t, "41.9", "-87.6") for i, (t, _) in enumerate(WALL_TIMES)]
    crashes = spark.createDataFrame(rows, "CRASH_RECORD_ID string, CRASH_DATE string, LATITUDE string, LONGITUDE string")
    cleaned = crash.clean_crashes(crashes)
    assert dict(cleaned.dtypes)["CRASH_DATETIME"] == "timestamp_ntz"
    assert [tuple(r) for r in agg.hour_counts(cleaned).collect()] == [(0, 3), (1, 1), (2, 3)]
    assert [tuple(map(str, r)) for r in agg.daily_counts(cleaned).collect()] == [("2024-01-01", "1"), ("2024-03-10", "5"), ("2024-11-03", "1")]
    assert [tuple(map(str, r)) for r in agg.monthly_counts(cleaned).collect()] == [("2024-01-01 00:00:00", "1"), ("2024-03-01 00:00:00", "5"), ("2024-11-01 00:00:00", "1")]
