"""Near duplicates by a grouped prefix join on word shingles, exact at every size.

Two sets link when ``100 * common >= percent * union``. Then, in any order of all shingles, the
first ``n - least_common + 1`` of each (its prefix) share one. The join uses this three times:

1. Any order of all shingles will do. The first one takes those below a bound of the hash first,
   and of these the ones of a single set before all others. Only these shingles are counted. A set
   with so many shingles of its own that they fill its prefix links with nothing: most texts end
   here.
2. For the other sets, equal ones taken as one, all shingles are counted and ordered from rare to
   frequent. Shingles of one set only use up the prefix; sets with the same size and the same rest
   of the prefix form one group. Group pairs are filtered by size and by the places of the shared
   shingle.
3. Of each list of groups that share a shingle, all are first joined to one hub: members of the one
   are verified against a member of the other. Pairs are expanded only where the ends are in
   different components after that, so that a large set of copies is joined along a star, and no
   link between components is lost. Each set has a parity map: a bit for each slot of the hash that
   is set when the slot holds an odd number of its shingles. Two maps differ in no more bits than
   their sets differ in shingles, so that pairs that differ in too many are left out by the join
   itself; for a part of a group, the bits that all and that any of its members have are compared.

Verification compares whole sets. Components are joined by rounds of label exchange on tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.language import in_slices
from roadgrain.llm.shared import Rows, documents, picked, stored, without
from roadgrain.llm.shingles import shingle_sets

WIDTH, PERCENT = 3, 90
#: The share of all hashes that the first order counts, in multiples of a prefix's share of its set.
REGION = 2.5
#: A shingle in more than this share of all lists' rows is hot; so there are at most this many.
HOT_SHARE = 2_000
HOT_ROWS = 1_000
#: Rows (a number each) up to which the sets to fetch are broadcast; beyond, they are joined by shuffle.
BROADCAST_SETS = 2_000_000
#: Words of 64 bits in the parity map of a set.
MAP_WORDS = 4

SETS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))]
)


def set_rows(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, *, whole: bool) -> DataFrame:
    """doc_id, text_hash, n, h1, h2 (two hashes of the whole set), shingles: the whole set or those below a bound.

    ``parity`` is the map of a whole set, and empty with those below a bound.
    """
    bound = np.uint64(min((1 << 64) - 1, int((1 << 64) * REGION * (100 - percent) / 100)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_slices(named_texts(batches)):
            sets = shingle_sets([t for _, t in group], width)
            cut = sets if whole else [s[: np.searchsorted(s, bound)] for s in sets]
            with np.errstate(over="ignore"):
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([np.bitwise_xor.reduce(s * (s >> np.uint64(32) | np.uint64(1))) if len(s) else 0 for s in sets], np.uint64)
            flat = np.concatenate([*cut, np.empty(0, np.uint64)]).view(np.int64)
            offsets = np.cumsum([0, *map(len, cut)]).astype(np.int32)
            maps = [parity_map(s) if whole else [] for s in sets]
            yield pa.record_batch(
                [
                    pa.array([k for (k, _), _ in group], pa.int64()),
                    pa.array([h for (_, h), _ in group], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(maps, pa.list_(pa.int64())),
                ],
                schema=SETS,
            )

    schema = "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, shingles array<bigint>, parity array<bigint>"
    return picked(df, id_col, text_col).mapInArrow(run, schema)


def parity_map(shingles: np.ndarray) -> list[int]:
    """A bit for each slot (leading bits of the hash): whether it holds an odd number of the shingles."""
    slots = (shingles >> np.uint64(64 - (64 * MAP_WORDS - 1).bit_length())).astype(np.int64)
    odd = np.bincount(slots, minlength=64 * MAP_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def named_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
        for doc_id, text_hash, text in zip(*columns, strict=True):
            yield (doc_id, text_hash), text or ""


def prefix_length(n: Column, percent: int) -> Column:
    """Shingles of which a set of n shares at least one with any set that it links to: n - ceil(percent n / 100) + 1."""
    return n - F.ceil(n * percent / F.lit(100).cast("double") - 1e-9).cast("bigint") + 1


def needed(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that sets of n and m need: ceil(percent (n + m) / (100 + percent))."""
    return F.ceil((n + m) * percent / F.lit(100 + percent).cast("double") - 1e-9).cast("bigint")


def hot_shingles(lists: DataFrame, n: Column, rows: int) -> DataFrame:
    """Shingles whose list is a large share of all rows, and in how many parts it is dealt; at most HOT_SHARE."""
    limit = max(HOT_ROWS, rows // HOT_SHARE)
    return lists.filter(n > limit).select("shingle", F.ceil(n / limit).alias("deals"))


def with_list(rows: DataFrame, lists: DataFrame, hot: DataFrame) -> DataFrame:
    """Each (shingle, ...) row with the one row of its list; hot lists are dealt over several tasks.

    ``hot`` is stored and has a fixed bound, so it is broadcast.
    """
    small = F.broadcast(hot)
    deal = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "deals"), F.lit(0))
    left = rows.join(small, "shingle", "left").withColumn("deal", deal).drop("deals")
    copies = F.expr("sequence(0L, coalesce(deals, 1L) - 1)")
    right = lists.join(small, "shingle", "left").withColumn("deal", F.explode(copies)).drop("deals")
    return left.join(right, ["shingle", "deal"]).drop("deal")


def survivors(rows: DataFrame, percent: int) -> DataFrame:
    """set_id, n, h1, h2, doc_id (the smallest) of the sets that may link with another one.

    A shingle whose rows all have one set hash is that set's own. Those are counted where they are
    grouped, so that no shingle goes back to its rows.
    """
    lists = rows.select("h1", F.explode("shingles").alias("shingle")).groupBy("shingle")
    lists = lists.agg(F.min("h1").alias("h1"), F.max("h1").alias("other")).filter("h1 = other")
    own = lists.groupBy("h1").agg(F.count(F.lit(1)).alias("own"))
    sets = rows.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    left = sets.join(own, "h1", "left").filter(F.coalesce("own", F.lit(0)) < prefix_length(F.col("n"), percent))
    return left.select(F.monotonically_increasing_id().alias("set_id"), "n", "h1", "h2", "doc_id")


def rare_first(rows: DataFrame, total: int, percent: int) -> DataFrame:
    """set_id, n, unique, prefix: shingles of the prefix that other sets hold, from rare to frequent.

    ``unique`` counts the shingles of no other set; they stand before all others. Sets whose unique
    shingles use up the prefix link with nothing and are left out.
    """
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"))
    lists = stored(lists.filter("k > 1"), "frequent")
    hot = stored(hot_shingles(lists, F.col("k"), total), "hot")
    shared = with_list(rows.select("set_id", "n", "shingle"), lists, hot)
    own = shared.groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "shingle"))).alias("order"))
    own = own.withColumn("unique", F.col("n") - F.size("order"))
    own = own.withColumn("length", prefix_length(F.col("n"), percent) - F.col("unique")).filter("length > 0")
    return own.select("set_id", "n", "unique", F.expr("slice(order.shingle, 1, int(length))").alias("prefix"))


def place_fits(percent: int) -> Column:
    """Whether groups a and b can link, given the places of a shingle they share."""
    least = needed(F.col("a.n"), F.col("b.n"), percent)
    before = F.least(F.col("a.at") - F.col("a.unique"), F.col("b.at") - F.col("b.unique"))
    after = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return sizes & (before + after >= least)


def part_maps(members: DataFrame, *by: str) -> DataFrame:
    """For each group of ``members``: the bits of the maps that all of them and that any of them have."""
    words = [F.get("parity", F.lit(i)) for i in range(MAP_WORDS)]
    both = [f(w).alias(f"{name}{i}") for i, w in enumerate(words) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    return members.groupBy(*by).agg(*both)


def map_fits(percent: int) -> Column:
    """Whether some members of parts a and b can link, given their maps."""
    words = [f"bit_count(a.all{i} & ~b.any{i}) + bit_count(b.all{i} & ~a.any{i})" for i in range(MAP_WORDS)]
    most = F.col("a.n") + F.col("b.n") - 2 * needed(F.col("a.n"), F.col("b.n"), percent)
    return F.expr(" + ".join(words)) <= most


def hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): the group that comes first in a shingle's list, and each other one that fits it."""
    first = F.min(F.struct("unique", "n", "group_id", "at")).alias("hub")
    lists = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), first)
    lists = stored(lists.filter("k > 1"), "hubs")
    hot = stored(hot_shingles(lists, F.col("k"), postings.count()), "hot")
    met = with_list(postings, lists, hot).filter(F.col("group_id") != F.col("hub.group_id"))
    met = met.select(F.struct("group_id", "n", "unique", "at").alias("b"), F.col("hub").alias("a"))
    return met.filter(place_fits(percent)).select(F.col("a.group_id").alias("a"), F.col("b.group_id").alias("b")).distinct()


def other_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, ca, b, cb): parts of groups in different components that share a shingle and fit.

    ``postings`` has a row for each shingle, group and component with members in it, and the maps of
    that part. Lists whose rows are all in one component are dropped first.
    """
    lists = postings.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = stored(lists.filter("lo < hi").select("shingle"), "mixed")
    rows = postings.join(mixed, "shingle", "left_semi")
    rows = stored(rows, "mixed-rows")
    a, b = rows.alias("a"), rows.alias("b")
    ordered = F.struct("a.group_id", "a.component") < F.struct("b.group_id", "b.component")
    both = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component")) & ordered & place_fits(percent) & map_fits(percent))
    names = [("a", "a.group_id"), ("ca", "a.component"), ("b", "b.group_id"), ("cb", "b.component")]
    return both.select(*[F.col(c).alias(n) for n, c in names]).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) pairs of sets that link, by their whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        for batch in batches:
            rows = Rows(schema, most=1 << 30)
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            left, right = batch.column("sx"), batch.column("sy")
            for i in range(batch.num_rows):
                a, b = (s[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for s in (left, right))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    rows.add(x[i], y[i])
            yield rows.take()

    own = sets.select("set_id", "shingles")
    met = pairs.join(own.select(F.col("set_id").alias("x"), F.col("shingles").alias("sx")), "x")
    met = met.join(own.select(F.col("set_id").alias("y"), F.col("shingles").alias("sy")), "y")
    return met.select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes with an edge.

    Each round points every node's larger neighbours at its smallest one, and its smaller ones too;
    the edges become stars in a number of rounds that grows with the logarithm of their longest path.
    """
    both = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct()
    edges, before = stored(both, "edges"), None
    while True:
        # Large star: every larger neighbour of a node goes to the smallest of its neighbours and itself.
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour of a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def link_sets(sets: DataFrame, percent: int) -> DataFrame:
    """set_id, component for the sets (set_id, n, shingles) that link with another one."""
    rows = sets.select("set_id", "n", F.explode("shingles").alias("shingle"))
    ordered = rare_first(rows, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], percent)
    grouped = ordered.withColumn("group_id", F.xxhash64("n", "prefix"))
    grouped = stored(grouped, "groups")
    # One row per group: sets of one size and prefix, in the order of their set_id.
    groups = grouped.groupBy("group_id", "n").agg(F.min("unique").alias("unique"), F.min("set_id").alias("head"), F.first("prefix").alias("prefix"))
    groups = stored(groups, "group-heads")
    placed = groups.select("group_id", "n", "unique", F.posexplode("prefix").alias("at", "shingle"))
    postings = stored(placed.withColumn("at", F.col("at") + F.col("unique")), "postings")
    members = grouped.select("group_id", "set_id")

    # First round: members against the head of their own group and of the groups that share a hub.
    heads = groups.select("group_id", "head")
    own = members.join(heads, "group_id").select(F.col("head").alias("x"), F.col("set_id").alias("y"))
    pairs = stored(hub_pairs(postings, percent), "hub-pairs")
    a, b = heads.select(F.col("group_id").alias("a"), F.col("head").alias("x")), members.select(F.col("group_id").alias("b"), F.col("set_id").alias("y"))
    forth = pairs.join(a, "a").join(b, "b").select("x", "y")
    a, b = members.select(F.col("group_id").alias("a"), F.col("set_id").alias("x")), heads.select(F.col("group_id").alias("b"), F.col("head").alias("y"))
    back = pairs.join(a, "a").join(b, "b").select("x", "y")
    stars = own.unionByName(forth).unionByName(back).filter("x <> y")
    stars = stored(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    links = stored(verified(stars, sets, percent), "links")
    first = stored(components(links), "components")

    # Second round: only pairs whose ends are still in different components.
    labelled = members.join(first.withColumnRenamed("node", "set_id"), "set_id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "set_id"))
    labelled = stored(labelled.join(sets.select("set_id", "n", "parity"), "set_id"), "labelled")
    parts = stored(part_maps(labelled, "group_id", "n", "component"), "parts")
    pairs = other_pairs(postings.join(parts.drop("n"), "group_id"), percent)
    same = (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.component") < F.col("b.component"))
    inside = parts.alias("a").join(parts.alias("b"), same & map_fits(percent))
    inside = inside.select(F.col("a.group_id").alias("a"), F.col("a.component").alias("ca"), F.col("b.group_id").alias("b"), F.col("b.component").alias("cb"))
    # The members of each part, with a map that is one set's alone.
    single = labelled.select("group_id", "component", "n", "set_id", *[F.get("parity", F.lit(i)).alias(f"{c}{i}") for i in range(MAP_WORDS) for c in ("all", "any")])
    left = pairs.unionByName(inside).join(single.withColumnsRenamed({"group_id": "a", "component": "ca"}), ["a", "ca"])
    apart = (F.col("a.b") == F.col("b.group_id")) & (F.col("a.cb") == F.col("b.component"))
    rest = left.alias("a").join(single.alias("b"), apart & map_fits(percent))
    rest = rest.select(F.col("a.set_id").alias("x"), F.col("b.set_id").alias("y"))
    rest = rest.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    tried = stored(rest.join(stars, ["x", "y"], "left_anti"), "pairs")
    more = stored(verified(tried, sets, percent), "links")
    if more.isEmpty():
        return first.withColumnRenamed("node", "set_id")
    known = first.select(F.col("node").alias("x"), F.col("component").alias("y"))  # stars already
    return components(known.unionByName(more)).withColumnRenamed("node", "set_id")


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, and text_hash to tell apart rows that repeat an id.

    Texts link when 100 * common >= percent * union of their sets of distinct ``width``-word
    shingles; the component's id is the smallest doc_id that links reach. NULL texts and texts
    without a word have no shingles and link with nothing, not even with each other. Rows that
    repeat a text are in one component; rows that repeat an id are rows of their own. NULL ids are
    never the smallest; a row whose component holds NULL ids only has a NULL component_id. An empty
    table gives no rows; other columns are not read.
    """
    rows = stored(set_rows(df, id_col, text_col, width, percent, whole=False), "sets")
    key = ["n", "h1", "h2"]
    sets = stored(survivors(rows, percent), "survivors")
    # Whole sets of the survivors, each from the rows of one id.
    fetch = F.broadcast(sets) if sets.count() <= BROADCAST_SETS else sets.hint("shuffle_hash")
    whole = set_rows(df, id_col, text_col, width, percent, whole=True).alias("w")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*key, "doc_id")]
    whole = whole.join(fetch.alias("s"), reduce(Column.__and__, same)).select("set_id", "w.n", "shingles", "parity")
    whole = stored(whole.dropDuplicates(["set_id"]), "whole-sets")
    joined = stored(link_sets(whole, percent), "components")

    least = joined.join(sets.select("set_id", "doc_id"), "set_id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "component").select("set_id", "component_id")
    linked = sets.join(named, "set_id").select(*key, "component_id")
    return with_components(rows.drop("shingles", "parity"), linked, key)


def with_components(rows: DataFrame, linked: DataFrame, key: list[str]) -> DataFrame:
    """The result for each row: its set's component, or the smallest id of its own set.

    Sets that many rows share are dealt over several tasks.
    """
    own = rows.filter("n > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("least"))
    own = own.join(linked, key, "left")
    ids = stored(own.select(*key, "k", F.coalesce("component_id", "least").alias("component_id")), "ids")
    limit = max(HOT_ROWS, (ids.agg(F.sum("k")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(stored(ids.filter(F.col("k") > limit).select(*key, F.ceil(F.col("k") / limit).alias("deals")), "hot"))
    deal = F.coalesce(F.pmod(F.xxhash64("doc_id"), "deals"), F.lit(0))
    left = rows.join(hot, key, "left").withColumn("deal", deal).drop("deals")
    right = ids.join(hot, key, "left").withColumn("deal", F.explode(F.expr("sequence(0L, coalesce(deals, 1L) - 1)")))
    named = left.join(right.drop("deals", "k"), [*key, "deal"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component, "text_hash")


#: DuckDB SQL for the query: prefixes by rarity, whole sets compared, components by reachable numbers.
SQL = r"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM texts),
kinds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, min(doc_id) AS doc_id, list_sort(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
rows AS MATERIALIZED (SELECT k, n, unnest(s) AS g FROM kinds),
shared AS MATERIALIZED (SELECT g, count(*) AS f FROM rows GROUP BY g),
placed AS MATERIALIZED (SELECT k, n, g, row_number() OVER (PARTITION BY k ORDER BY f, g) AS place FROM rows JOIN shared USING (g)),
heads AS MATERIALIZED (SELECT * FROM placed WHERE place <= n - (90 * n + 99) // 100 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.k AS x, b.k AS y FROM heads a JOIN heads b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN kinds a ON a.k = x JOIN kinds b ON b.k = y
  WHERE 190 * len(list_intersect(a.s, b.s)) >= 90 * (a.n + b.n)),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(k, r) AS (SELECT k, k FROM kinds WHERE k IN (SELECT x FROM ways) UNION SELECT y, r FROM reach JOIN ways ON x = k WHERE r < y),
least AS (SELECT k, min(r) AS r FROM reach GROUP BY k),
named AS (SELECT a.s, coalesce(b.doc_id, a.doc_id) AS component_id FROM kinds a LEFT JOIN least l ON l.k = a.k LEFT JOIN kinds b ON b.k = l.r)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN named ON list_sort(sets.s) = named.s"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` with all their columns, of each component only those with the smallest id.

    Rows with a NULL id stay.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col, width=width, percent=percent)
    return without(df, found.filter("component_id < doc_id"), id_col, text_col)
