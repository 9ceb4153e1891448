"""Group-by operators. Each is one pass with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions.clean import as_number, computed_once, day_name, month_start, present
from roadgrain.functions.features import non_fatal, safe_rate

PEOPLE_COUNTS = ("persons", "pedestrians", "cyclists")
VEHICLE_COUNTS = ("vehicles", "speeding_veh")
# What is summed per cause, and of which column.
IMPACT_SUMS = {
    "total_impact": "impact_score",
    "fatalities": "inj_fatal",
    "severe_injuries": "inj_sev",
    "nonsevere_injuries": "inj_nonsev",
    "possible_injuries": "inj_possible",
}
# Days in chart order.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def people_summary(people: DataFrame, key: str) -> DataFrame:
    """Per crash: persons, pedestrians and cyclists. A count without its column is NULL."""
    unknown = F.lit(None).cast("long")
    typed = "PERSON_TYPE" in people.columns
    pedestrians = unknown
    if "PEDPED_FLAG" in people.columns:
        pedestrians = F.sum(as_number("PEDPED_FLAG")).try_cast("long")
    elif typed:
        pedestrians = _count_where(F.col("PERSON_TYPE") == "PEDESTRIAN")
    cyclists = _count_where(F.col("PERSON_TYPE") == "BICYCLE") if typed else unknown
    return people.groupBy(key).agg(
        F.count("PERSON_ID").alias("persons"),
        pedestrians.alias("pedestrians"),
        cyclists.alias("cyclists"),
    )


def vehicles_summary(vehicles: DataFrame, key: str) -> DataFrame:
    """Per crash: vehicles, and those whose cause mentions SPEED (NULL without that column)."""
    speeding = F.lit(None).cast("long")
    if "PRIM_CONTRIBUTORY_CAUSE" in vehicles.columns:
        speeding = _count_where(F.col("PRIM_CONTRIBUTORY_CAUSE").contains("SPEED"))
    return vehicles.groupBy(key).agg(
        F.count("VEHICLE_ID").alias("vehicles"), speeding.alias("speeding_veh")
    )


def daily_counts(df: DataFrame, ts: str = "CRASH_DATETIME") -> DataFrame:
    """Crashes per day, for days with any."""
    days = present(df, ts).groupBy(F.to_date(ts).alias("CRASH_DATE"))
    return days.agg(F.count(F.lit(1)).alias("count")).orderBy("CRASH_DATE")


def monthly_counts(df: DataFrame, ts: str = "CRASH_DATETIME") -> DataFrame:
    """Crashes per month, keyed by the month's first instant."""
    months = present(df, ts).groupBy(month_start(ts).alias("CRASH_MONTH"))
    return months.agg(F.count(F.lit(1)).alias("count")).orderBy("CRASH_MONTH")


def hour_counts(df: DataFrame, hour: str = "HOUR") -> DataFrame:
    """Crashes per hour of day."""
    hours = present(df, hour).groupBy(hour)
    return hours.agg(F.count(F.lit(1)).alias("count")).orderBy(hour)


def dow_counts(df: DataFrame, ts: str = "CRASH_DATETIME") -> DataFrame:
    """Crashes per day of the week, Monday to Sunday, 0 for a day without any."""
    counts = (
        present(df, ts)
        .groupBy(day_name(ts).alias("DAY_OF_WEEK"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return fill_domain(counts, "DAY_OF_WEEK", DAYS, {"count": F.lit(0).cast("long")})


def fill_domain(
    df: DataFrame, column: str, values: Sequence[str], defaults: dict[str, Column]
) -> DataFrame:
    """One row per value, in the given order, with ``defaults`` for those the frame lacks.

    ``df`` is an aggregate with one row per value of ``column``; other values are left out.
    """
    order = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    domain = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(column)
    )
    filled = domain.join(df, column, "left")
    return filled.orderBy(order).select(
        column, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()]
    )


def injury_share(df: DataFrame, flag: str = "injury_any") -> DataFrame:
    """Rows, injured rows and their share."""
    totals = df.agg(F.count(F.lit(1)).alias("crashes"), F.count_if(flag).alias("injured"))
    return totals.withColumn("injury_share", safe_rate("injured", "crashes"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; NULL is a value. ``k`` keeps the top of the list."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc_nulls_last(column))
    return ordered if k is None else ordered.limit(k)


def counts_by_each(df: DataFrame, dims: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """Rows and flagged rows per value of each dimension by itself, and of all rows, from one scan.

    Columns: ``dimension`` (a name, or '' for all rows), the dimensions (NULL but for that one), ``count``
    and a count per flag. NULL is a value of a dimension.
    """
    names = list(dims)
    taken = df.select(*[c.alias(n) for n, c in dims.items()], *[c.alias(f"__{f}") for f, c in flags.items()])
    counted = taken.groupingSets([[], *([F.col(n)] for n in names)], *names).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("count"), *[F.count_if(f"__{f}").alias(f) for f in flags]
    )
    # A bit of the id is 0 for the dimension that is grouped by, the first name's bit being the highest.
    every = 2 ** len(names) - 1
    ids = {every - 2 ** (len(names) - 1 - i): n for i, n in enumerate(names)} | {every: ""}
    told = F.element_at(F.create_map(*[F.lit(x).cast(t) for i, n in ids.items() for x, t in ((i, "long"), (n, "string"))]), F.col("__set").cast("long"))
    return counted.select(told.alias("dimension"), *names, "count", *flags)


def injury_rate_by(df: DataFrame, column: str, k: int, flag: str = "injury_any") -> DataFrame:
    """The ``k`` values of ``column`` with the highest share of injured rows."""
    groups = df.groupBy(column).agg(
        F.count(F.lit(1)).alias("crashes"), F.count_if(flag).alias("injured")
    )
    rated = groups.select(column, safe_rate("injured", "crashes").alias("injury_rate"))
    return rated.orderBy(F.desc("injury_rate"), F.asc_nulls_last(column)).limit(k)


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent ``value`` per group, NULL being a value; ties go to the smallest, NULL last.

    Rows are counted per (group, value) first, so the second step sees one row per distinct value
    and combines map-side.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(most_frequent("__n", value).alias(name))


def most_frequent(count: str, value: str) -> Column:
    """Aggregate: the ``value`` of the largest ``count``; ties to the smallest value, NULL last."""
    best = F.min(F.struct((-F.col(count)).alias("n"), F.col(value).isNull().alias("z"), F.col(value).alias("v")))
    return best["v"]


def hotspot_cells(
    df: DataFrame, cause: str | None = None, cell: Sequence[str] = ("lat_bin", "lon_bin")
) -> DataFrame:
    """Per grid cell: crashes, injury and fatal crashes, injury rate, fatal flag and top cause.

    Crashes are counted per (cell, cause) and those counts are summed per cell, which also yields
    the top cause: one scan, no join back, and a crowded cell arrives as one row per cause.
    """
    by_cause = df.groupBy(*cell, *([cause] if cause else [])).agg(
        F.count("LAT").alias("__n"),
        F.count_if("injury_any").alias("__injured"),
        F.count_if("is_fatal").alias("__fatal"),
        F.count(F.lit(1)).alias("__rows"),
    )
    cells = by_cause.groupBy(*cell).agg(
        F.sum("__n").alias("count"),
        F.sum("__injured").alias("injury_any_count"),
        F.sum("__fatal").alias("fatal_count"),
        (most_frequent("__rows", cause) if cause else F.lit("")).alias("top_cause"),
    )
    return cells.withColumns(
        {
            "injury_rate": safe_rate("injury_any_count", "count"),
            "fatal_flag": F.col("fatal_count") > 0,
            "lat": F.col(cell[0]),
            "lon": F.col(cell[1]),
        }
    )


def rank_cells(cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` cells with most crashes, then most fatal ones, then the highest injury rate."""
    order = [F.desc("count"), F.desc("fatal_count"), F.desc("injury_rate"), "lat_bin", "lon_bin"]
    return cells.orderBy(*order).limit(k)


def cause_impact(df: DataFrame, cause: str = "PRIM_CONTRIBUTORY_CAUSE") -> DataFrame:
    """Per cause: geolocated crashes, total impact and injured people; sums skip NULL."""
    return df.groupBy(cause).agg(
        F.count("LAT").alias("crashes"), *[F.sum(c).alias(name) for name, c in IMPACT_SUMS.items()]
    )


def rank_causes(causes: DataFrame, k: int, cause: str = "PRIM_CONTRIBUTORY_CAUSE") -> DataFrame:
    """The ``k`` causes with the highest impact, then fatalities, then crashes."""
    order = [F.desc_nulls_last(c) for c in ("total_impact", "fatalities", "crashes")]
    return causes.orderBy(*order, F.asc_nulls_last(cause)).limit(k).withColumnRenamed(cause, "cause")


def fatal_rate(df: DataFrame, column: str, counts: tuple[str, str] | None = None) -> DataFrame:
    """Rows and share of ``is_fatal`` rows per value.

    Of rows that are counted already, ``counts`` names the columns with all and with fatal cases.
    """
    total, fatal = F.count(F.lit(1)), F.count_if("is_fatal")
    if counts is not None:
        total, fatal = (F.sum(c) for c in counts)
    groups = df.groupBy(column).agg(total.alias("__n"), fatal.alias("__fatal"))
    return groups.withColumn("fatal_rate", safe_rate("__fatal", "__n"))


def group_fatal_rate(
    df: DataFrame, column: str, counts: tuple[str, str] | None = None, k: int | None = None
) -> DataFrame:
    """Fatal share per value, highest first; ``k`` keeps the top of the list."""
    rated = fatal_rate(df, column, counts).select(column, "fatal_rate")
    ordered = rated.orderBy(F.desc("fatal_rate"), F.asc_nulls_last(column))
    return ordered if k is None else ordered.limit(k)


def topk_group_fatal_rate(
    df: DataFrame, column: str, k: int, counts: tuple[str, str] | None = None
) -> DataFrame:
    """Fatal share of the ``k`` most frequent values, highest first.

    NULL takes one of the ``k`` places but is not shown. Counts and shares come from the same
    aggregate, so the rows are read once and never joined to the list of top values.
    """
    top = (
        fatal_rate(df, column, counts)
        .orderBy(F.desc("__n"), F.asc_nulls_last(column))
        .limit(k)
    )
    shown = top.where(F.col(column).isNotNull()).select(column, "fatal_rate")
    return shown.orderBy(F.desc("fatal_rate"), column)


def hourly_fatal(df: DataFrame, hour: str = "HOUR", fatal: str = "is_fatal") -> DataFrame:
    """Per hour: all, fatal and other crashes with their shares."""
    hours = (
        present(df, hour)
        .groupBy(hour)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(fatal).alias("fatal"))
        .withColumn("nonfatal", non_fatal("total", "fatal"))
    )
    return hours.withColumns(
        {
            "fatal_rate": safe_rate("fatal", "total"),
            "nonfatal_rate": safe_rate("nonfatal", "total"),
        }
    ).orderBy(hour)


def risk_cells(df: DataFrame) -> DataFrame:
    """Mean impact score per grid cell. Own definition: only a finished map of it is known."""
    return df.groupBy("lat_bin", "lon_bin").agg(
        F.count("impact_score").alias("crashes"), F.avg("impact_score").alias("risk")
    )


def exact_median(
    df: DataFrame, columns: Sequence[str], bins: int = 50_000, weight: str | None = None
) -> DataFrame:
    """Exact median per column, as rows (axis, median), without sorting the values.

    With ``weight``, a row stands for that many equal rows, see :func:`weighted_middle`.

    A histogram of ``bins`` bins between the least and the largest value shows which bin holds the
    middle ranks, a second one divides that bin, and a last pass counts the distinct values of the
    bin found. So no task gets more than ``bins`` rows, or the distinct values of one bin in
    ``bins`` squared, whatever the range of the values and however many rows share one.
    """
    if weight is not None:
        ends = weighted_middle(df, columns, weight)
        return ends.groupBy("axis").agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns])
    values = df.select(F.lit(1).cast("long").alias("w"), F.inline(pairs)).where("v is not null and not isnan(v)")
    # One row per column, then one or two bins per column.
    reach = values.groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(0).cast("long").alias("offset"), F.sum("w").alias("total"))
    for level in range(2):
        spot = (values.v >= F.col("lo")) & (values.v <= F.col("hi"))
        inside = values.join(F.broadcast(reach), "axis").where(spot)
        width = (F.col("hi") - F.col("lo")) / bins
        bin_ = F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width)).otherwise(0).cast("long")
        hist = inside.groupBy("axis", "lo", "offset", "total", bin_.alias("bin")).agg(
            F.sum("w").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        found = _middle_ranks(hist)
        # Both middle ranks may lie in neighbouring bins: what holds them spans from one to the other.
        reach = found.groupBy("axis").agg(
            F.min("least").alias("lo"), F.max("most").alias("hi"), F.min("before").alias("offset"), F.first("total").alias("total")
        )
    spot = (values.v >= F.col("lo")) & (values.v <= F.col("hi"))
    inside = values.join(F.broadcast(reach), "axis").where(spot)
    counted = inside.groupBy("axis", "offset", "total", "v").agg(F.sum("w").alias("n"))
    ends = _middle_ranks(counted.withColumn("bin", F.col("v")))
    medians = ends.groupBy("axis").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return medians.select("axis", ((F.col("a") + F.col("b")) / 2).alias("median"))


def _middle(total: str) -> tuple[Column, Column]:
    """The two middle ranks of ``total`` values, equal when that is odd."""
    n = F.col(total)
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def _middle_ranks(hist: DataFrame) -> DataFrame:
    """Histogram rows that hold a middle rank, with the number of values before them.

    ``offset`` values lie before the histogram's first bin.
    """
    by = Window.partitionBy("axis")
    running = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ranked = hist.withColumn("before", F.col("offset") + F.coalesce(running, F.lit(0)))
    low, high = _middle("total")
    return ranked.where((F.col("before") < high) & (F.col("before") + F.col("n") >= low))


def median_center(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Exact centre of the located rows as one row (lat, lon)."""
    medians = exact_median(present(df, "LAT", "LON"), ["LAT", "LON"], weight=weight)
    pick = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("median")))
    return medians.agg(pick("LAT").alias("lat"), pick("LON").alias("lon"))


def approx_center(df: DataFrame, accuracy: int = 10_000, weight: str | None = None) -> DataFrame:
    """Map centre by an approximate median; its rank is off by at most ``1 / accuracy`` of the rows.

    With ``weight``, a row stands for that many equal rows, and the rank is exact.
    """
    if weight is None:
        return df.agg(F.percentile_approx("LAT", 0.5, accuracy).alias("lat"), F.percentile_approx("LON", 0.5, accuracy).alias("lon"))
    middle = weighted_middle(df, ["LAT", "LON"], weight)
    return middle.agg(*[F.min(F.when(F.col("axis") == c, F.col("v"))).alias(n) for c, n in (("LAT", "lat"), ("LON", "lon"))])


def weighted_middle(df: DataFrame, columns: Sequence[str], weight: str, ranges: int = 64) -> DataFrame:
    """The values at the two middle ranks of each column, as rows (axis, v), one where they are equal.

    A row stands for ``weight`` equal rows and none is repeated for it: weights are summed per value,
    before the shuffle first, and again per range of values. Ranges hold like numbers of distinct
    values, and only the one or two with a middle rank are put in order. The rows are read once, as all
    steps after the first share its shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in columns])
    values = df.where(F.col(weight) > 0).select(F.col(weight).cast("long").alias("w"), F.inline(pairs))
    values = values.where("v is not null and not isnan(v)")
    counted = computed_once(values.groupBy("axis", "v").agg(F.sum("w").alias("w")))
    # One row of cuts per column.
    shares = [i / ranges for i in range(1, ranges)]
    cuts = counted.groupBy("axis").agg(F.percentile_approx("v", shares, 10 * ranges).alias("cuts"))
    ranged = counted.join(F.broadcast(cuts), "axis").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = ranged.groupBy("axis", "bin").agg(F.sum("w").alias("n"))
    totals = sums.withColumns({"total": F.sum("n").over(Window.partitionBy("axis")), "offset": F.lit(0).cast("long")})
    found = _middle_ranks(totals).select("axis", "bin", "total", F.col("before").alias("offset"))
    inside = ranged.join(F.broadcast(found), ["axis", "bin"])
    # Values of a second range go on counting where the first one ends.
    first = inside.withColumn("offset", F.min("offset").over(Window.partitionBy("axis")))
    return _middle_ranks(first.withColumnRenamed("w", "n").withColumn("bin", F.col("v"))).select("axis", "v")
