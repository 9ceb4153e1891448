"""Ordered operators: rolling mean and exact capped selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roadgrain.functions.clean import computed_once


def rolling_mean(series: DataFrame, order: str, value: str, rows: int, name: str) -> DataFrame:
    """Mean over the last ``rows`` rows present, NULL until there are that many.

    For an aggregated series (one row per day): the window runs in one task.
    """
    last = Window.orderBy(order).rowsBetween(1 - rows, 0)
    full = F.count(F.lit(1)).over(last) == rows
    return series.withColumn(name, F.when(full, F.avg(value).over(last))).orderBy(order)


Pick = tuple[int | None, Sequence[Column]]
"""How many rows of each layer to pick, and the numbers that rank them, smallest first."""

#: Leading hex digits of the hash that the first histogram tells apart, without and with ranking numbers, and of the second.
FIRST_DIGITS, RANKED_DIGITS, NEXT_DIGITS = 3, 2, 3


def capped(
    df: DataFrame,
    n: int | None,
    columns: Sequence[str],
    layer: str | None = None,
    first: Sequence[Column] = (),
    weight: str | None = None,
    seed: int = 0,
    digits: int | None = None,
) -> DataFrame:
    """Exactly the first ``n`` rows per ``layer`` (fewer if it has fewer); the same on every run.

    ``n=None`` keeps all rows. See :func:`capped_each`.
    """
    return capped_each(df, {"": (n, first)}, columns, layer, weight, seed, digits)[""]


def capped_each(
    df: DataFrame,
    picks: Mapping[str, Pick],
    columns: Sequence[str],
    layer: str | None = None,
    weight: str | None = None,
    seed: int = 0,
    digits: int | None = None,
    sums: Mapping[str, Column] | None = None,
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Several exact selections from one frame, which is read twice for all of them together.

    Rows are ordered by a pick's ranking numbers (few distinct ones), then by a hash of ``columns``, so
    that without numbers it is a random sample without replacement. ``layer`` has few values, or
    ``choose`` leaves few; NULL is one of them. With ``weight``, a row stands for that many equal rows,
    or for none. ``choose`` gets a row per layer with the ``sums`` and returns those to keep, with all
    columns; columns that it adds are passed on.

    The first reading makes one histogram by layer, numbers and leading digits of the hash; ``sums``
    come from it too. It says in which place of each layer the last wanted row lies. The second reading
    keeps what lies up to there and counts equal rows together. From that shuffle, which is used again
    and not read anew, a histogram of the next digits bounds what is left to sort: the wanted rows and
    one bucket of the ties.
    """
    by, sums = [layer] if layer else [], sums or {}
    rest = [c for c in columns if c not in by]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    keys = {name: [f"__{i}first{j}" for j in range(len(first))] for i, (name, (_, first)) in enumerate(picks.items())}
    ranks = [f.alias(k) for name, (_, first) in picks.items() for f, k in zip(first, keys[name], strict=True)]
    every = [k for own in keys.values() for k in own]
    totals = [f"__sum{i}" for i in range(len(sums))]
    hashed = df.select(
        *by,
        *rest,
        *ranks,
        *[c.alias(t) for c, t in zip(sums.values(), totals, strict=True)],
        (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("__w"),
        F.md5(F.concat_ws("|", *text, F.lit(str(seed)))).alias("__h"),
    )

    summed = [F.sum(t).alias(c) for t, c in zip(totals, sums, strict=True)]
    choose = choose or (lambda layers: layers)
    result = {}
    if any(n is None for n, _ in picks.values()):
        whole, extra = hashed.where("__w > 0"), []
        if summed:
            listed = choose(hashed.groupBy(*by).agg(*summed)).drop(*sums)
            whole, extra = _of_layers(whole, listed, by), [c for c in listed.columns if c not in by]
        if weight is not None:
            whole = whole.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__w")))
        result = {name: whole.select(*by, *extra, *rest) for name, (n, _) in picks.items() if n is None}
    picks = {name: n for name, (n, _) in picks.items() if n is not None}
    if not picks:
        return result

    digits = digits or (RANKED_DIGITS if every else FIRST_DIGITS)
    placed = computed_once(hashed.withColumn("__p", F.substring("__h", 1, digits)))
    hist = placed.groupBy(*by, *every, "__p").agg(F.sum("__w").alias("__n"), *[F.sum(t).alias(t) for t in totals])
    places = [F.struct(*keys[name], "__p") for name in picks]
    reached = []
    for i, (place, n) in enumerate(zip(places, picks.values(), strict=True)):
        ahead = _layer_window(by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn(f"__before{i}", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        reached.append(_reached(place, F.lit(n).cast("long"), f"__before{i}").alias(f"__cut{i}"))
    # One use of the histogram for all picks and sums.
    cuts = choose(hist.groupBy(*by).agg(*reached, *summed)).drop(*sums)
    extra = [c for c in cuts.columns if c not in by and not c.startswith("__cut")]
    flags = []
    for i, place in enumerate(places):
        last = F.col(f"__cut{i}.p")
        flags += [(place <= last).alias(f"__in{i}"), (place == last).alias(f"__tie{i}"), F.col(f"__cut{i}.w").alias(f"__want{i}")]
    near = _of_layers(placed.where("__w > 0"), cuts, by).select(*by, *extra, *every, "__h", *rest, "__w", *flags)
    near = near.where(reduce(lambda a, b: a | b, [F.col(f"__in{i}") for i in range(len(picks))]))
    groups = [c for c in near.columns if c != "__w"]
    # Filters stay above this, so that all that follows reads one shuffle.
    counted = computed_once(near.groupBy(*groups).agg(F.sum("__w").alias("__w")))
    counted = counted.withColumn("__p", F.substring("__h", 1 + digits, NEXT_DIGITS))
    for i, (name, n) in enumerate(picks.items()):
        ties = counted.where(f"__tie{i}").groupBy(*by, "__p").agg(F.sum("__w").alias("__n"), F.first(f"__want{i}").alias("__want"))
        ahead = _layer_window(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        ties = ties.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        last = ties.groupBy(*by).agg(_reached(F.col("__p"), F.col("__want"), "__before").alias("__cut"))
        kept = _of_layers(counted.where(f"__in{i}"), last, by).where(f"not __tie{i} or __p <= __cut.p")
        order = [*keys[name], "__h", *rest]
        ahead = _layer_window(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        taken = kept.withColumn("__left", n - F.coalesce(F.sum("__w").over(ahead), F.lit(0))).where("__left > 0")
        copies = F.sequence(F.lit(1).cast("long"), F.least("__w", "__left"))
        result[name] = taken.withColumn("__copy", F.explode(copies)).select(*by, *extra, *rest)
    return result


def _layer_window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _reached(place: Column, want: Column, before: str) -> Column:
    """Aggregate over counted places (``__n``): ``p``, the last one that the wanted rows reach, ``w``, how many are wanted from there on."""
    inside = (F.col("__n") > 0) & (F.col(before) < want)
    return F.max(F.when(inside, F.struct(place.alias("p"), (want - F.col(before)).alias("w"))))


def _of_layers(rows: DataFrame, layers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the listed layers with their further columns; one row per layer is broadcast, and NULL is a layer.

    Without a layer there is one row at most; without any, no row is left.
    """
    more = [c for c in layers.columns if c not in by]
    if not by:
        found = rows.withColumn("__one", layers.select(F.struct(*more)).scalar()).where("__one is not null")
        return found.select(*rows.columns, *[F.col(f"__one.{c}").alias(c) for c in more])
    named = F.broadcast(layers.withColumnRenamed(by[0], "__layer"))
    return rows.join(named, F.col(by[0]).eqNullSafe(F.col("__layer"))).drop("__layer")
