"""Joins, aggregates, capped selection and layers against hand-made or brute-force results."""

from __future__ import annotations

import hashlib
import random
import re
import statistics
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from roadgrain.functions import features
from roadgrain.operators import aggregates as agg
from roadgrain.operators import joins, layers
from roadgrain.operators.windows import capped, rolling_mean
from roadgrain.plans import crash, drivers
from roadgrain.sources.tables import Tables

KEY = "CRASH_RECORD_ID"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- Joins ----------------------------------------------------------------------------------


@pytest.mark.parametrize("min_rows", [1, 20, 10**9])
def test_join_hot_equals_plain_join(spark, min_rows):
    """A third of the left rows share a key, another third have none, and one right key repeats."""
    rng = random.Random(1)
    left = [("hot", i) for i in range(100)] + [(None, i) for i in range(100)]
    left += [(f"k{rng.randrange(40)}", i) for i in range(100)]
    right = [("hot", f"r{i}") for i in range(3)] + [("k1", f"d{i}") for i in range(60)]
    right += [(f"k{i}", f"s{i}") for i in range(0, 40, 2)] + [(None, "never")]
    a = spark.createDataFrame(left, "k string, a int").repartition(6)
    b = spark.createDataFrame(right, "k string, b string").repartition(5)
    got = joins.join_hot(a, b, ["k"], min_rows)
    assert got.columns == ["k", "a", "b"]
    assert rows(got) == rows(a.join(b, "k", "left"))
    inner = joins.join_hot(a, b, ["k"], min_rows, how="inner")
    assert rows(inner) == rows(a.join(b, "k"))


def test_join_hot_with_unique_right_and_two_keys(spark):
    a = spark.createDataFrame([("x", "1", 1)] * 30 + [("x", None, 2), (None, "1", 3), ("y", "2", 4)], "k string, v string, n int")
    b = spark.createDataFrame([("x", "1", "hit"), ("x", "2", "miss")], "k string, v string, b string")
    got = joins.join_hot(a.repartition(4), b, ["k", "v"], 5, right_unique=True)
    assert rows(got) == rows(a.join(b, ["k", "v"], "left"))


def test_hot_keys_are_found(spark):
    df = spark.createDataFrame([("hot",)] * 50 + [(f"k{i}",) for i in range(50)] + [(None,)] * 99, "k string")
    assert rows(joins.hot_keys(df, ["k"], 20)) == [("hot", 3)]


def test_hundreds_of_hot_keys_and_a_small_share_are_found(spark):
    many = spark.range(300 * 5_000).select((F.col("id") % 300).cast("string").alias("k"))
    found = joins.hot_keys(many, ["k"], 1_000)
    assert found.count() == 300 and found.where("__parts = 5").count() == 300
    n, share = 4_000_000, 1_300
    one = spark.range(n).select(F.when(F.col("id") % share == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    assert rows(joins.hot_keys(one, ["k"], 1_000)) == [("hot", 4)]
    right = spark.createDataFrame([("hot", 1)], "k string, n int")
    got = joins.join_hot(one, right, ["k"], 1_000, right_unique=True, how="inner")
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == -(-n // share)


def test_summaries_and_attach(spark):
    people = spark.createDataFrame(
        [("a", "1", "PEDESTRIAN"), ("a", "2", "BICYCLE"), ("a", None, "DRIVER"), ("b", "3", "DRIVER"), (None, "4", "DRIVER")],
        f"{KEY} string, PERSON_ID string, PERSON_TYPE string",
    )
    vehicles = spark.createDataFrame(
        [("a", "v1", "X SPEED Y"), ("a", "v2", None), ("c", "v3", "OTHER")],
        f"{KEY} string, VEHICLE_ID string, PRIM_CONTRIBUTORY_CAUSE string",
    )
    crashes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], f"{KEY} string")
    got = joins.attach_summaries(crashes, agg.people_summary(people, KEY), agg.vehicles_summary(vehicles, KEY))
    assert rows(got) == sorted(
        [
            ("a", 2, 1, 1, 2, 1), ("b", 1, 0, 0, None, None), ("c", None, None, None, 1, 0),
            ("d", None, None, None, None, None), (None, None, None, None, None, None),
        ],
        key=repr,
    )


def test_summary_without_optional_columns(spark):
    people = spark.createDataFrame([("a", "1")], f"{KEY} string, PERSON_ID string")
    assert rows(agg.people_summary(people, KEY)) == [("a", 1, None, None)]
    flagged = spark.createDataFrame([("a", "1", "1"), ("a", "2", "x")], f"{KEY} string, PERSON_ID string, PEDPED_FLAG string")
    assert rows(agg.people_summary(flagged, KEY)) == [("a", 2, 1, None)]
    vehicles = spark.createDataFrame([("a", "v")], f"{KEY} string, VEHICLE_ID string")
    assert rows(agg.vehicles_summary(vehicles, KEY)) == [("a", 1, None)]


def driver_tables(spark):
    """Hot crash, NULL ids, repeated vehicles and crashes, people without a crash."""
    people = [("hot", "1", "DRIVER", str(a % 70), "il") for a in range(60)]
    people += [("hot", None, " driver ", "30", "IL ") for _ in range(20)]
    people += [("b", "2", "DRIVER", None, None), ("b", "2", "PASSENGER", "40", "in"), ("zz", "9", "Driver", "80", "in")]
    people += [(None, "1", "DRIVER", "20", "wi"), ("c", "7", "DRIVER", "24.5", "in")]
    vehicles = [("hot", "1", "CAR"), ("hot", "1", "VAN"), ("b", "2", "CAR"), ("c", "8", "CAR"), (None, "1", "CAR")]
    crashes = [
        ("hot", "01/02/2024 01:00:00 PM", "41.9", "-87.6", "wet", "1"),
        ("b", "2024-01-03", "41.8", "-87.7", "dry", "0"),
        ("b", "2024-01-03", "41.8", "-87.7", "dry", "2"),
        ("c", "junk", None, "-87.7", " Dry", "x"),
    ]
    return Tables(
        spark.createDataFrame(
            crashes,
            f"{KEY} string, CRASH_DATE string, LATITUDE string, LONGITUDE string, ROADWAY_SURFACE_COND string, INJURIES_FATAL string",
        ),
        spark.createDataFrame(people, f"{KEY} string, VEHICLE_ID string, PERSON_TYPE string, AGE string, DRIVER_LICENSE_STATE string"),
        spark.createDataFrame(vehicles, f"{KEY} string, VEHICLE_ID string, VEHICLE_TYPE string"),
        spark.createDataFrame([("hot",), ("hot",)], f"{KEY} string"),
    )


@pytest.mark.parametrize("min_rows", [5, 10**9])
def test_driver_rows_equal_plain_joins(spark, min_rows):
    t = driver_tables(spark)
    p = drivers.driver_people(t.people)
    c = drivers.driver_crashes(t.crashes)
    plain = p.join(t.vehicles, [KEY, "VEHICLE_ID"], "left").join(c, KEY, "left")
    keep = [KEY, "VEHICLE_ID", "VEHICLE_TYPE", "age_bin", "license_state", "surface", "HOUR"]
    got = drivers.joined_drivers(t, min_rows)
    assert rows(got.select(*keep)) == rows(plain.select(*keep))
    assert got.where("fatal_outcome is null").isEmpty()


@pytest.mark.parametrize("dims", [(["age_bin"], []), (["license_state"], []), ([], ["surface"]), (["age_bin"], ["surface", "LAT"])])
def test_counted_drivers_equal_joined_rows(spark, dims):
    t = driver_tables(spark)
    by = [*dims[0], *dims[1]]
    sums = [F.sum("drivers").alias("n"), F.sum("fatal_drivers").alias("f")]
    got = drivers.counted_drivers(t, *dims).groupBy(*by).agg(*sums)
    want = drivers.joined_drivers(t).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("fatal_outcome").alias("f"))
    assert rows(got) == rows(want)


def test_vehicle_id_only_and_no_ids(spark):
    people = spark.createDataFrame([("a", "1"), ("b", None)], f"{KEY} string, VEH_ID string")
    vehicles = spark.createDataFrame([("1", "CAR")], "VEHICLE_ID string, BODY_TYPE string")
    assert rows(joins.drivers_with_vehicles(people, vehicles, KEY)) == [("1", "a", "CAR"), (None, "b", None)]
    bare = spark.createDataFrame([("a",)], f"{KEY} string")
    assert joins.drivers_with_vehicles(bare, vehicles, KEY) is bare


def test_flag_members(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], f"{KEY} string")
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("q",)], f"{KEY} string")
    assert rows(joins.flag_members(df, ids, KEY, "hit")) == [("a", True), ("a", True), ("b", False), (None, False)]


def test_fatalities_decide_without_a_count_column(spark):
    t = driver_tables(spark)
    crashes = t.crashes.drop("INJURIES_FATAL")
    flagged = crash.with_flags(crash.clean_crashes(crashes), t.fatalities)
    assert rows(flagged.select(KEY, "is_fatal").distinct()) == [("b", False), ("c", False), ("hot", True)]
    assert rows(drivers.driver_crashes(crashes, t.fatalities).where("fatal_outcome").select(KEY)) == [("hot",)]


# --- Aggregates -----------------------------------------------------------------------------


def test_group_mode_ties_and_null(spark):
    data = [("g", "b"), ("g", "a"), ("h", None), ("h", None), ("h", "z"), ("i", None), ("i", "z")]
    df = spark.createDataFrame(data, "g string, v string")
    assert rows(agg.group_mode(df, ["g"], "v", "m")) == [("g", "a"), ("h", None), ("i", "z")]


def test_hotspot_cells_equal_separate_steps(spark):
    rng = random.Random(2)
    data = [
        (41.8 + rng.randrange(3) / 1000, -87.6, rng.choice(["A", "B", "C", None]), rng.random() < 0.5 or None, rng.random() < 0.1)
        for _ in range(500)
    ]
    df = spark.createDataFrame(data, "lat_bin double, lon_bin double, cause string, injury_any boolean, is_fatal boolean")
    df = df.withColumn("LAT", F.col("lat_bin"))
    fused = agg.hotspot_cells(df, "cause")
    modes = agg.group_mode(df, ["lat_bin", "lon_bin"], "cause", "top_cause")
    split = agg.hotspot_cells(df).drop("top_cause").join(modes, ["lat_bin", "lon_bin"])
    assert rows(fused.select(*sorted(fused.columns))) == rows(split.select(*sorted(fused.columns)))
    assert fused.agg(F.sum("count")).first()[0] == 500


def test_topk_group_fatal_rate_null_takes_a_place(spark):
    data = [(None, False)] * 5 + [("a", True)] * 3 + [("b", False)] * 2 + [("c", True)]
    df = spark.createDataFrame(data, "g string, is_fatal boolean")
    assert [tuple(r) for r in agg.topk_group_fatal_rate(df, "g", 3).collect()] == [("a", 1.0), ("b", 0.0)]


def test_fill_domain_and_dow(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-08 10:00:00",), (None,)], "t string")
    df = df.select(F.col("t").cast("timestamp").alias("CRASH_DATETIME"))
    got = [tuple(r) for r in agg.dow_counts(df).collect()]
    assert got[0] == ("Monday", 2) and got[6] == ("Sunday", 0) and len(got) == 7


def test_rolling_mean_counts_rows_present(spark):
    days = [(date(2024, 1, d), c) for d, c in [(1, 1), (2, 2), (5, 6), (9, 10)]]
    got = rolling_mean(spark.createDataFrame(days, "d date, c bigint"), "d", "c", 3, "m").collect()
    assert [r.m for r in got] == [None, None, 3.0, 6.0]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    rng = random.Random(n)
    # A third of the rows share one value.
    data = [(41.88 if rng.random() < 0.34 else 41.6 + rng.random() / 2, -88 + rng.random() / 2) for _ in range(n)]
    df = spark.createDataFrame([*data, (None, None), (float("nan"),) * 2], "LAT double, LON double")
    got = agg.median_center(df).first()
    assert got.lat == pytest.approx(statistics.median(x for x, _ in data), abs=1e-12)
    assert got.lon == pytest.approx(statistics.median(y for _, y in data), abs=1e-12)


def test_exact_median_with_weights(spark):
    rng = random.Random(5)
    data = [(41.6 + rng.random() / 2, -88 + rng.random() / 2, rng.randrange(1, 40)) for _ in range(101)]
    got = agg.median_center(spark.createDataFrame(data, "LAT double, LON double, w int"), "w").first()
    assert got.lat == pytest.approx(statistics.median([x for x, _, w in data for _ in range(w)]), abs=1e-12)
    assert got.lon == pytest.approx(statistics.median([y for _, y, w in data for _ in range(w)]), abs=1e-12)


def test_exact_median_over_a_wide_range(spark):
    rng = random.Random(8)
    data = [rng.choice((-1, 1)) * 10 ** rng.uniform(-3, 7) for _ in range(2_001)]
    df = spark.createDataFrame([(v, 1e7 * v) for v in data], "LAT double, LON double")
    for bins in (4, 50_000):
        got = {r["axis"]: r["median"] for r in agg.exact_median(df, ["LAT", "LON"], bins).collect()}
        assert got == {"LAT": statistics.median(data), "LON": statistics.median([1e7 * v for v in data])}


def test_exact_median_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "LAT double, LON double")
    assert tuple(agg.median_center(df).first()) == (None, None)


def test_approx_center_rank_error(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("LAT"), F.lit(1.0).alias("LON"))
    got = agg.approx_center(df, 100).first()
    assert abs(got.lat - 5000) <= 100 and got.lon == 1.0


def test_weighted_middle_equals_repeated_rows(spark):
    rng = random.Random(11)
    for n in (1, 2, 7, 40, 400):
        data = [(rng.choice([None, float("nan"), *map(float, range(-9, 200))]), rng.choice([0, 1, 1, 2, 1_000])) for _ in range(n)]
        df = spark.createDataFrame([*data, (500.0, 0)], "x double, w int")
        values = sorted(v for v, w in data for _ in range(w) if v is not None and v == v)
        got = sorted(r["v"] for r in agg.weighted_middle(df, ["x"], "w").collect())
        assert got == sorted({values[(len(values) - 1) // 2], values[len(values) // 2]} if values else [])


def test_weights_are_not_unrolled(spark):
    df = spark.createDataFrame([(41.0 + i / 1000, -87.0, 3_000_000_000 if i == 700 else 1) for i in range(1_000)], "LAT double, LON double, w long")
    center = agg.approx_center(df, weight="w")
    assert center.first() == (41.7, -87.0)
    text = center._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in text


def test_approx_center_counts_drivers(spark):
    """A fatal crash with three drivers counts three times, one without drivers not at all."""
    crashes = [("a", "41.7", "-87.7", "1"), ("b", "41.8", "-87.8", "1"), ("c", "41.9", "-87.9", "1"), ("d", "42.0", "-87.5", "0")]
    people = [(f"p{i}", "a", "DRIVER") for i in range(3)] + [("p3", "b", "DRIVER"), ("p4", "c", "PASSENGER"), ("p5", "d", "DRIVER")]
    t = Tables(
        spark.createDataFrame(crashes, f"{KEY} string, LATITUDE string, LONGITUDE string, INJURIES_FATAL string"),
        spark.createDataFrame(people, f"PERSON_ID string, {KEY} string, PERSON_TYPE string"),
        spark.createDataFrame([("a", "v", "x")], f"{KEY} string, VEHICLE_ID string, VEHICLE_TYPE string"),
        spark.createDataFrame([("a",)], f"{KEY} string"),
    )
    points = drivers.fatal_driver_points(t, (), ["LAT", "LON"])
    assert rows(points.select("LAT", "fatal_drivers")) == [(41.7, 3), (41.8, 1)]
    assert tuple(agg.approx_center(points, weight="fatal_drivers").first()) == (41.7, -87.7)


def test_numbers_must_be_finite(spark):
    bad = ["nan", "NaN", "Infinity", "-inf", "x", None]
    df = spark.createDataFrame([(b, "1") for b in bad], "n string, m string")
    got = df.select(
        features.injury_any(["n"]).alias("any"), features.fatal_flag("n").alias("fatal"), features.age_bin("n").alias("age")
    ).distinct()
    assert rows(got) == [(None, False, "UNKNOWN")]
    people = df.select(F.lit("k").alias(KEY), F.lit("p").alias("PERSON_ID"), F.col("n").alias("PEDPED_FLAG"))
    assert rows(agg.people_summary(people.unionByName(people.withColumn("PEDPED_FLAG", F.lit("2"))), KEY)) == [("k", 12, 12, None)]
    causes = [("A", "nan", "1"), ("A", "2", "0"), ("B", "1", "0")]
    df = spark.createDataFrame(causes, "PRIM_CONTRIBUTORY_CAUSE string, INJURIES_FATAL string, INJURIES_POSSIBLE string")
    impact = agg.cause_impact(features.with_impact(df).withColumn("LAT", F.lit(1.0)))
    assert rows(agg.rank_causes(impact, 1).select("cause", "total_impact")) == [("A", 20.0)]


def test_invariants(spark):
    t = driver_tables(spark)
    c = crash.clean_crashes(t.crashes)
    dated = c.where("CRASH_DATETIME is not null").count()
    assert agg.daily_counts(c).agg(F.sum("count")).first()[0] == dated
    assert agg.hour_counts(c).agg(F.sum("count")).first()[0] == dated
    assert crash.combined(Tables(t.crashes, t.people.withColumn("PERSON_ID", F.lit("p")), t.vehicles, t.fatalities)).count() == c.count()


# --- Capped selection -----------------------------------------------------------------------


def expected(data, n, columns, first=lambda r: ()):
    """Brute force: order by ``first`` and the hash of the columns, keep ``n`` per layer."""
    def rank(r):
        text = "|".join(["" if r[c] is None else str(r[c]) for c in columns] + ["0"])
        return first(r), hashlib.md5(text.encode()).hexdigest()

    picked = Counter()
    for layer in {r["layer"] for r in data}:
        some = sorted((r for r in data if r["layer"] == layer), key=rank)[:n]
        picked.update((layer, *[r[c] for c in columns]) for r in some)
    return picked


@pytest.mark.parametrize("n", [1, 10, 50, 10_000])
@pytest.mark.parametrize("digits", [1, 4])
def test_capped_equals_brute_force(spark, n, digits):
    rng = random.Random(n)
    data = [{"layer": rng.choice("xy"), "id": rng.choice(["hot", f"i{k}"]), "v": rng.randrange(3)} for k in range(300)]
    df = spark.createDataFrame([(r["layer"], r["id"], r["v"]) for r in data], "layer string, id string, v int").repartition(5)
    plain = capped(df, n, ["id", "v"], "layer", digits=digits)
    assert Counter(map(tuple, plain.collect())) == expected(data, n, ["id", "v"])
    worst = capped(df, n, ["id", "v"], "layer", first=[-F.col("v")], digits=digits)
    assert Counter(map(tuple, worst.collect())) == expected(data, n, ["id", "v"], lambda r: -r["v"])


def test_capped_with_weights_equals_repeated_rows(spark):
    data = [("x", f"i{k}", k % 4 + 1) for k in range(50)] + [("x", "hot", 1000)]
    counted = spark.createDataFrame(data, "layer string, id string, w int")
    repeated = counted.withColumn("r", F.explode(F.expr("sequence(1, w)"))).drop("r", "w")
    for n in (5, 700, 5000):
        got = Counter(map(tuple, capped(counted, n, ["id"], "layer", weight="w").collect()))
        assert got == Counter(map(tuple, capped(repeated, n, ["id"], "layer").collect()))
        assert sum(got.values()) == min(n, 1000 + sum(w for _, i, w in data if i != "hot"))


def test_capped_without_layer_and_empty(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"))
    first, again = (rows(capped(df, 10, ["id"])) for _ in range(2))
    assert first == again and len(first) == 10
    assert rows(capped(df, 10, ["id"], seed=1)) != first
    assert capped(df.where("id = 'none'"), 10, ["id"]).isEmpty()


def test_capped_keeps_missing_layers_and_all_rows_without_a_cap(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "l string, v int")
    assert Counter(r[0] for r in capped(df, 1, ["v"], "l").collect()) == {"a": 1, None: 1}
    assert {r[0] for r in capped(df, 5, ["v"], "l").collect()} == {"a", None}
    assert capped(df, None, ["v"], "l").count() == 4 and capped(df, 0, ["v"]).isEmpty()
    weighted = df.withColumn("w", F.col("v") - 1)
    assert capped(weighted, None, ["v"], "l", weight="w").count() == 0 + 1 + 2 + 3


@pytest.mark.parametrize("cap", [50_000, 5_000, 3_000, 40_000])
def test_capped_past_each_cap(spark, cap):
    df = spark.range(2 * cap + 7).select(F.lit("x").alias("l"), F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("v"))
    got = capped(df, cap, ["id", "v"], "l", first=[-F.col("v")])
    assert got.count() == got.distinct().count() == cap
    assert got.where("v = 2").count() == min(cap, df.where("v = 2").count())


# --- Layers ---------------------------------------------------------------------------------


def test_hotspot_layer_radius(spark):
    data = [(1, 0, False), (2, 0, False), (9, 1, True), (100, 0, False), (10**6, 0, False)]
    df = spark.createDataFrame(data, "count bigint, fatal_count bigint, fatal_flag boolean").withColumns(
        {"lat": F.lit(41.8), "lon": F.lit(-87.6), "injury_any_count": F.lit(0), "top_cause": F.lit(None).cast("string")}
    )
    got = layers.hotspot_layer(df).collect()
    assert [r.radius for r in got] == [4, 4, 9, 30, 30]
    assert [r.color for r in got] == ["#1a9850", "#1a9850", "#d73027", "#1a9850", "#1a9850"]
    assert got[2].popup == "Count: 9<br>Injuries: 0<br>Fatal: 1<br>Top cause: None"


def test_top_cause_layers_skip_the_missing_cause(spark):
    data = [(str(i), cause, 41.8, -87.6, s, f, 0.0) for i, (cause, s, f) in enumerate(
        [(None, 50.0, 5.0), ("A", 20.0, 2.0), ("B", 5.0, 0.0), ("B", 4.0, 0.0), ("C", 1.0, 0.0), ("A", None, 0.0)]
    )]
    df = spark.createDataFrame(
        data, f"{KEY} string, PRIM_CONTRIBUTORY_CAUSE string, LAT double, LON double, impact_score double, inj_fatal double, inj_sev double"
    ).withColumns({"inj_nonsev": F.lit(0.0), "inj_possible": F.lit(0.0)})
    got = layers.top_cause_layers(df, KEY, k=3, circle_cap=1)
    circles = rows(got.where("kind = 'circle'").select("layer", KEY, "radius", "color"))
    assert circles == [("Cause: A", "1", 7, "#000000"), ("Cause: B", "2", 5, "#2c7bb6")]
    assert got.where("kind = 'heat'").count() == 3


def test_fatal_points_tell_what_the_table_has(spark):
    df = spark.createDataFrame([("1", 41.8, -87.6, True, "X")], f"{KEY} string, LAT double, LON double, is_fatal boolean, PRIM_CONTRIBUTORY_CAUSE string")
    assert layers.fatal_points(df, KEY).first().popup == "Fatal crash | Cause: X"
    assert layers.fatal_points(df.drop("PRIM_CONTRIBUTORY_CAUSE"), KEY).first().popup == "Fatal crash"


def test_layers_keep_their_caps(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias(KEY),
        (41.7 + F.col("id") / 10000).alias("LAT"),
        F.lit(-87.6).alias("LON"),
        F.lit(True).alias("is_fatal"),
        F.current_timestamp().alias("CRASH_DATETIME"),
        F.lit("X").alias("PRIM_CONTRIBUTORY_CAUSE"),
        F.when(F.col("id") < 900, "DAY").otherwise("NIGHT").alias("period"),
    )
    assert layers.heat_points(df, KEY, 50).count() == 50
    assert layers.marker_points(df, KEY, 30).count() == 30
    assert layers.fatal_points(df, KEY, 20).count() == 20
    got = layers.period_heat(df, KEY, 200).groupBy("layer").count()
    assert rows(got) == [("DAY", 200), ("NIGHT", 100)]
    assert rows(layers.period_heat(df.drop("period"), KEY, 5).groupBy("layer").count()) == [("ALL", 5)]


def test_hot_lists_give_keys_and_rows(spark):
    many = spark.range(90).selectExpr("if(id < 60, 'hot', if(id < 70, null, cast(id as string))) as k", "id % 2 as v")
    lists, n = joins.hot_lists([(many, ["k"]), (many, ["k", "v"]), (many.where("k <> 'hot'"), ["k"]), (many.limit(0), ["k"])], 20)
    assert n == [90, 90, 20, 0] and lists[2] is None and lists[3] is None
    assert [tuple(r) for r in lists[0].collect()] == [("hot", 3)]
    assert sorted(tuple(r) for r in lists[1].collect()) == [("hot", 0, 2), ("hot", 1, 2)]


def test_join_of_many_rows_has_its_own_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    assert joins.parts_for(80) is None and joins.parts_for(171) == 18
    left = spark.range(200).selectExpr("if(id % 4 = 0, null, cast(id as string)) as k", "id as x")
    right = spark.range(200).selectExpr("cast(id as string) as k", "id as y")
    want = rows(left.join(right, ["k"], "left"))
    for hot in ((None, None), None):
        assert rows(joins.join_hot(left, right, ["k"], 50, hot=hot, parts=18).select("k", "x", "y")) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for parts, n in ((18, 18), (None, int(spark.conf.get("spark.sql.shuffle.partitions")))):
            plan = joins.join_hot(left, right, ["k"], 50, hot=(None, None), parts=parts)._jdf.queryExecution().executedPlan().toString()
            # By key and salt, so that rows without a key do not meet in one task.
            assert len(re.findall(rf"hashpartitioning\(k#\d+, __salt_l#\d+, {n}\)", plan)) == 2
            assert plan.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
