"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from roadgrain.llm import neighbours

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("list", T.StringType())]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            scores = vectors @ v
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def found(df, **options):
    out = {}
    for r in neighbours.search(df, **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows in out.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(130)]
    want, got = brute(rows, 20), found(frame(spark, rows))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_of_probed_lists(spark, monkeypatch):
    """Many lists, of which a part is probed; vectors of different lengths; a third of the rows equal."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    rows = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(32)).tolist()) for i in range(2_000)]
    rows += [(2_000 + i, rows[0][1]) for i in range(1_000)]
    want, got = brute(rows, 20), found(frame(spark, rows))
    assert got.keys() == want.keys() and all(len(r) == 20 for r in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # ties go to the smaller ids


def test_an_outlying_group_is_filled_up_from_further_lists(spark, monkeypatch):
    """Tight groups and six vectors far from all: their query gets twenty rows too."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 50)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 3
    rows = [(i, (centres[i % 40] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(2_000)]
    rows += [(2_000 + i, (50 + rng.standard_normal(16)).tolist()) for i in range(6)]
    want, got = brute(rows, 20), found(frame(spark, rows))
    assert all(len(r) == 20 for r in got.values()) and got.keys() == want.keys()
    assert {i for i, _ in got[2_000][:5]} == set(range(2_001, 2_006))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0], [1.0, nan], [inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(20 * (i + 1), v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]
    got = found(frame(spark, rows))
    assert got == {0: [(2, 1.0), (1, 0.5)]}
    assert neighbours.search(frame(spark, [])).count() == 0
    assert found(frame(spark, [(0, [1.0])])) == {}


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])]
    assert found(frame(spark, rows)) == {0: [(1, 0.0), (1, 0.0)]}


@pytest.mark.parametrize("n", [1, 600, 3_000])
def test_adaptive_scan_keeps_the_nearest(n):
    rng = np.random.default_rng(n)
    vectors, queries = rng.standard_normal((n, 64)), rng.standard_normal((9, 64))
    rotation, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    ids = rng.permutation(n)
    hits = total = 0
    for q, (own, got, scores) in zip(queries, neighbours.adaptive_scan(ids, vectors, rotation, queries, np.full(9, -1), 20), strict=True):
        exact = vectors @ q
        top = set(ids[np.lexsort((ids, -exact))[:20]].tolist())
        assert own == -1 and len(got) == min(20, n) and np.all(np.diff(scores) <= 0)
        assert np.allclose(exact[np.argsort(ids)][got], scores)
        hits, total = hits + len(top & set(got.tolist())), total + len(top)
    assert hits / total >= 0.97
