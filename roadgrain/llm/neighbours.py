"""Nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Vectors are turned by a random rotation and dealt to lists by k-means centres. A query looks into
the lists whose centres are nearest; how many, is measured on a sample of queries against all rows. Within a list the rotated vectors lie in blocks of columns: a
query adds up squared distances block by block, and a candidate whose partial distance says, by a
test at a fixed level, that it cannot reach the nearest ones found so far is given up. What is left
is scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm.shared import stored

K = 20
#: Vectors per list, about, and lists at most.
LIST_ROWS, MOST_LISTS = 512, 4096
#: Queries that are compared with all vectors, and the share of their true neighbours that the probed lists must hold.
TRIED_QUERIES, HELD_SHARE = 128, 0.95
#: Vectors that the centres are learned from, about, and rounds of k-means.
TRAIN_ROWS, ROUNDS = 20_000, 8
#: A list longer than this is dealt to several tasks; so are the queries of a list.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Columns per block and the level of the test.
COLUMNS, LEVEL = 16, 2.1
#: Candidates between two looks at the threshold.
STEP = 512

FOUND = "query_id bigint, vec_id bigint, score double"
ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Lists:
    """Rotation and centres; ``centres`` are rotated."""

    rotation: np.ndarray
    centres: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each vector, nearest first."""
        turned = vectors @ self.rotation
        far = (self.centres**2).sum(axis=1) - 2 * (turned @ self.centres.T)
        if n >= len(self.centres):
            return np.argsort(far, axis=1, kind="stable")
        part = np.argpartition(far, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(far, part, axis=1), axis=1, kind="stable")
        return np.take_along_axis(part, order, axis=1)


def usable(vec: Column) -> Column:
    """Not NULL, not empty, no component NULL or not finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (double): usable vectors of the commonest length (the smaller of two equally common)."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("vec") == (lengths["d"] if lengths else 0))


def learn_lists(vectors: DataFrame, n: int, *, seed: int = 11) -> Lists:
    """Centres of a bounded sample, by k-means on the rotated vectors; the sample goes to the driver."""
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000
    sample = vectors.filter(draw < min(1.0, TRAIN_ROWS / n)).orderBy("vec_id").limit(2 * TRAIN_ROWS).select("vec").collect()
    if not sample:
        sample = vectors.orderBy("vec_id").limit(TRAIN_ROWS).select("vec").collect()
    rows = np.array([r["vec"] for r in sample], np.float64)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((rows.shape[1], rows.shape[1])))
    rows = np.unique(rows @ rotation, axis=0)
    count = max(1, min(MOST_LISTS, n // LIST_ROWS, len(rows)))
    centres = rows[rng.choice(len(rows), count, replace=False)]
    for _ in range(ROUNDS):
        own = ((centres**2).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        held = np.bincount(own, minlength=count)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return Lists(rotation, centres)


def assign(vectors: DataFrame, lists: Lists, n: int, enough: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """vec_id, vec (packed doubles), list, near (0 for the nearest list): a row for each of the n nearest lists.

    ``enough`` has the rows of each list and how many a vector's lists must hold together at least: one
    whose n nearest hold fewer gets further ones.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((lists, enough))
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("list", pa.int32()), ("near", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            own, filled = shared.value
            for at in range(0, len(rows), 1024):
                part = np.ascontiguousarray(rows[at : at + 1024], "<f8")
                if filled is None:
                    near = own.nearest(part, n)
                    times = np.full(len(part), near.shape[1])
                    taken = near.ravel()
                else:
                    near = own.nearest(part, len(own.centres))
                    short = np.cumsum(filled[0][near], axis=1) < filled[1]
                    times = np.clip(np.maximum(n, short.sum(axis=1) + 1), 1, near.shape[1])
                    taken = near[np.arange(near.shape[1]) < times[:, None]]
                packed = [r.tobytes() for r in part]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(ids[at : at + 1024], times)),
                        pa.array([p for p, k in zip(packed, times, strict=True) for _ in range(k)], pa.binary()),
                        pa.array(taken.astype(np.int32)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in times])),
                    ],
                    schema=schema,
                )

    return vectors.mapInArrow(run, "vec_id bigint, vec binary, list int, near int")


def probes_needed(members: DataFrame, asked: DataFrame, lists: Lists, k: int) -> int:
    """Lists that a query must look into: a bounded sample of queries is compared with all vectors,

    and the least number is taken whose lists hold ``HELD_SHARE`` of the true neighbours.
    """
    tried = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED_QUERIES).collect()
    ids = np.array([r["vec_id"] for r in tried], np.int64)
    rows = np.array([r["vec"] for r in tried], np.float64)
    shared = members.sparkSession.sparkContext.broadcast((ids, rows))
    schema = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("list", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            if not len(own):
                continue
            vectors = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f8").reshape(len(own), -1)
            scores = np.where(query_ids[:, None] == own, -np.inf, queries @ vectors.T)
            most = min(k, len(own))
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            number = np.repeat(np.arange(len(query_ids), dtype=np.int32), most)
            flat = best.ravel()
            columns = [number, own[flat], batch.column("list").to_numpy()[flat], scores[number, flat]]
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    near = members.select("vec_id", "vec", "list").mapInArrow(run, "query int, vec_id bigint, list int, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("score") > float("-inf")))
    found = near.select("query", "list").collect()  # at most k rows for each query tried
    if not found:
        return len(lists.centres)
    places = np.argsort(lists.nearest(rows, len(lists.centres)), axis=1)
    ranks = np.sort([places[r["query"], r["list"]] for r in found])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(HELD_SHARE * len(ranks))) - 1)]) + 1


def adaptive_scan(
    ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None
):
    """(query id, ids, scores) of the best candidates of one block, for each query, none below its floor.

    |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so the k-th best inner product so far gives each candidate the
    distance that it must undercut; after d of D columns the test compares the partial sum times D/d
    with that distance, widened by 1 + LEVEL / sqrt(d).
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    turned, norms = vectors @ rotation, (vectors**2).sum(axis=1)
    dims = turned.shape[1]
    cuts = [*range(0, dims, COLUMNS), dims]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    slack = [(1 + LEVEL / np.sqrt(b)) ** 2 * b / dims for b in cuts[1:]]
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    for query, own, turned_query, floor in zip(queries, query_ids, queries @ rotation, floors, strict=True):
        length, best_ids, best = query @ query, np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(ids), STEP):
            alive = np.arange(start, min(start + STEP, len(ids)))
            alive = alive[ids[alive] != own]
            least = max(floor, best[k - 1]) if len(best) >= k else floor
            if least > -np.inf:
                most = length + norms[alive] - 2 * least + 1e-9 * (1 + length)
                partial = np.zeros(len(alive))
                for a, b, block, wide in zip(cuts, cuts[1:], blocks, slack, strict=False):
                    partial += ((block[alive] - turned_query[a:b]) ** 2).sum(axis=1)
                    stays = partial <= np.maximum(most, 0) * wide + 1e-12
                    if not stays.all():
                        alive, partial, most = alive[stays], partial[stays], most[stays]
                    if not len(alive):
                        break
            if not len(alive):
                continue
            exact = (vectors[alive] * query).sum(axis=1)
            scores = np.concatenate((best, exact[exact >= floor]))
            found = np.concatenate((best_ids, ids[alive[exact >= floor]]))
            top = np.lexsort((found, -scores))[:k]
            best_ids, best = found[top], scores[top]
        yield own, best_ids, best


def search(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    queries: str = "vec_id % 20 = 0",
    k: int = K,
) -> DataFrame:
    """The k rows of largest inner product for each query row: query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id. All vectors are indexed; NULL, empty, zero vectors, those
    with a NULL or non-finite component, those of another length than the commonest and rows with a
    NULL id take no part. Ties go to the smaller vec_id. Rows that repeat an id are candidates each
    for itself, and the first of them by vector asks. Fewer candidates give fewer rows; an empty
    table gives none; other columns are not read.
    """
    spark = df.sparkSession
    vectors = stored(vectors_of(df, id_col, vec_col), "vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lists = learn_lists(vectors, n)
    asked = vectors.filter(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    members = stored(assign(vectors, lists, 1), "members")
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # One row per list, at most MOST_LISTS; a query's own id, which may be repeated, is no candidate.
    held = np.zeros(len(lists.centres), np.int64)
    for row in members.groupBy("list").count().collect():
        held[row["list"]] = row["count"]
    repeats = vectors.filter(queries).groupBy("vec_id").count().agg(F.max("count")).first()[0]
    probes = stored(assign(asked, lists, probes_needed(members, asked, lists, k), (held, k + repeats)), "probes")

    # The nearest lists first: what is found there bounds what the others put out.
    first = F.col("near") <= F.floor(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("vec_id"))))
    probes = stored(probes.withColumn("first", first), "ranked-probes")
    early = probes.filter("first").withColumn("floor", F.lit(float("-inf")))
    early = stored(best_of(scan_lists(members, early, lists, k), k), "early")
    floors = early.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    late = probes.filter("not first").join(floors, "vec_id", "left").fillna(float("-inf"), ["floor"])
    return best_of(early.drop("rank").unionByName(scan_lists(members, late, lists, k)), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by score, ties to the smaller vec_id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def scan_lists(members: DataFrame, probes: DataFrame, lists: Lists, k: int) -> DataFrame:
    """The best candidates of each probed list that are not below the floor of the query."""
    # One row per list, at most MOST_LISTS: in how many parts its members and its queries are dealt.
    sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    asks = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    deals = F.broadcast(stored(sizes.join(asks, "list"), "deals"))
    block, part = F.expr("pmod(xxhash64(vec_id, vec), blocks)"), F.expr("pmod(xxhash64(vec_id), parts)")
    left = members.join(deals, "list").select("list", "vec_id", "vec", block.alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    right = probes.join(deals, "list").select("list", "vec_id", "vec", "floor", part.alias("part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    key = ["list", "block", "part"]
    cast = {"block": F.col("block").cast("int"), "part": F.col("part").cast("int")}
    shared = members.sparkSession.sparkContext.broadcast(lists)

    def scan(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return ARROW.empty_table()

        def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            rows = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(table.num_rows, -1)
            return table.column("vec_id").to_numpy(), rows

        (ids, rows), (query_ids, query_rows) = unpacked(own), unpacked(asking)
        out = list(adaptive_scan(ids, rows, shared.value.rotation, query_rows, query_ids, k, asking.column("floor").to_numpy()))
        return pa.table(
            [
                pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), pa.int64()),
                pa.array(np.concatenate([i for _, i, _ in out]), pa.int64()),
                pa.array(np.concatenate([s for _, _, s in out]), pa.float64()),
            ],
            schema=ARROW,
        )

    return left.withColumns(cast).groupBy(*key).cogroup(right.withColumns(cast).groupBy(*key)).applyInArrow(scan, FOUND)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
