"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadgrain.llm import exact, jaccard, shared, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(map(repr, out)), len(groups)


def check_exact(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = exact.exact_duplicates(df, **options).collect()
    want, groups = brute_exact(rows)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found) == want
    stay = [r for r in found if r["kept"]]
    assert len(stay) == groups == len({r["text_sha256"] for r in stay})
    assert all(r["doc_id"] == r["keep_id"] for r in stay)


@pytest.mark.parametrize("options", [{}, {"key_bits": 3, "bucket_keys": 2}, {"bucket_keys": 4, "hot_rows": 10}])
def test_exact_duplicates_equal_brute_force(docs, options):
    """A third of the rows share a text; with three key bits every key is a chain of collisions."""
    rng = random.Random(4)
    rows = [(i, "the  hot\ttext" if i % 3 == 0 else f"text {rng.randrange(60)}" + " " * rng.randrange(3)) for i in range(300, 0, -1)]
    check_exact(docs(rows), **options)


def test_exact_duplicates_of_odd_rows(odd, empty):
    check_exact(odd)
    assert exact.exact_duplicates(empty).count() == 0


def test_directory_splits_overfull_buckets(spark, docs):
    df = docs([(i, f"text {i}") for i in range(500)])
    index, rows = exact.build_index(df, "doc_id", "text", exact.KEY_BITS, 40)
    assert rows == 500 and index.count() == 500
    buckets = index.groupBy("bucket", "local_depth").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    found = buckets.orderBy("bucket").collect()
    assert len(found) > 500 / 40 and all(b["n"] <= 40 for b in found)
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:], strict=False))
    depths = {b["local_depth"] for b in found}
    assert len(depths) > 1  # slots of different buckets differ in depth


def test_keep_first_names_rows_by_id_and_text(docs):
    df = docs([(1, "a"), (0, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "a"), (None, "d")])
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(
        map(repr, [(0, "a"), (1, "b"), (2, "c"), (None, "d")])
    )


def shingle_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_near(rows, width, percent):
    """Component of each row by comparing all pairs of texts."""
    sets = [shingle_set(t, width) for _, t in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    parent = list(range(len(kinds)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            common = len(a & kinds[j])
            if 100 * common >= percent * (len(a) + len(kinds[j]) - common):
                parent[root(i)] = root(j)
    number = {s: i for i, s in enumerate(kinds)}
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            r = root(number[s])
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(
        repr((doc_id, len(s), least.get(root(number[s])) if s else doc_id)) for (doc_id, _), s in zip(rows, sets, strict=True)
    )


def check_near(df, width=3, percent=90):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = jaccard.near_duplicates(df, width=width, percent=percent).collect()
    want = brute_near(rows, width, percent)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == want
    return len({r["component_id"] for r in found})


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(rng, n, vocabulary=500):
    """Near copies of a few texts with 0 to 6 edits, a passage that many share, chains, exact copies."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    bases = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(5)]
    passage, rows = [word() for _ in range(40)], []
    for i in range(n):
        kind = i % 5
        if kind < 2:
            words = edited(rng, bases[0 if kind == 0 else rng.randrange(5)], rng.randrange(7))
        elif kind == 2:
            words = passage + [word() for _ in range(rng.randrange(1, 40))]
        elif kind == 3:
            words = bases[1]
        else:
            words = [word() for _ in range(rng.randrange(1, 60))]
        rows.append((1_000 - i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, width, percent):
    components = check_near(docs(corpus(random.Random(width), 400)), width, percent)
    assert 100 < components < 330


def test_near_duplicates_along_a_chain(docs):
    """Each text links with the next one only: labels must travel the whole chain."""
    words = [f"c{i}" for i in range(140)]
    rows = [(100 - i, " ".join(words[i : i + 60])) for i in range(0, 80)]
    check_near(docs(rows), 3, 90)


def test_near_duplicates_of_odd_rows(odd, empty):
    check_near(odd)
    assert jaccard.near_duplicates(empty).count() == 0


def test_parity_maps_never_tell_more_apart_than_the_sets_differ(spark):
    """For single sets and for parts of several sets, the bits that differ are no more than the shingles that do."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 300), replace=False), base[: rng.integers(0, 5)]])) for _ in range(60)]
    rows = [(i % 20, i, jaccard.parity_map(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "part long, set_id long, parity array<long>")
    for by in ("set_id", "part"):
        maps = {r[by]: r for r in jaccard.part_maps(df, by).collect()}
        bits = lambda r, c: [r[f"{c}{i}"] & (1 << 64) - 1 for i in range(jaccard.MAP_WORDS)]  # noqa: E731, B023
        member = {i: (i if by == "set_id" else i % 20) for i in range(60)}
        for x in range(60):
            for y in range(x):
                a, b = maps[member[x]], maps[member[y]]
                apart = sum((p & ~q).bit_count() for p, q in zip(bits(a, "all"), bits(b, "any"), strict=True))
                apart += sum((p & ~q).bit_count() for p, q in zip(bits(b, "all"), bits(a, "any"), strict=True))
                assert apart <= len(np.setxor1d(sets[x], sets[y]))


def test_near_copies_that_link_with_few_others(docs):
    """A large group of copies so far apart that most share a prefix and do not link."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(2, 9)))) for i in range(300)]
    components = check_near(docs(rows), 5, 80)
    assert 20 < components < 290


def test_near_duplicates_sql_equals_brute_force():
    rows = corpus(random.Random(6), 250) + [(5_000, None), (5_001, ""), (5_002, "A b"), (5_003, "a B"), (5_004, " \x0b")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    with duckdb.connect() as db:
        db.register("documents", documents)
        found = db.execute(jaccard.SQL).fetchall()
    assert sorted(map(repr, found)) == brute_near(rows, 3, 90)


def test_keep_one_of_each_group(docs):
    base = " ".join(f"w{i}" for i in range(100))
    df = docs([(3, base), (1, base + " more"), (2, "other text of its own"), (None, base), (7, None), (8, "")])
    kept = jaccard.keep_one(df, width=5, percent=80)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8, None}


def test_shingle_hashes_tell_sets_apart():
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "ab", "ba", "aa", "é", "A"], k=rng.randrange(30))) for _ in range(500)]
    texts += ["", " ", "a", "a b", "\ta\nb\x0bc\x0cd\r"]
    own = shingles.shingle_sets(texts, 3)
    assert [len(s) for s in own] == [len(shingle_set(t, 3)) for t in texts]
    names = {}
    for s, t in zip(own, texts, strict=True):
        assert names.setdefault(s.tobytes(), shingle_set(t, 3)) == shingle_set(t, 3)


def test_shingles_do_not_depend_on_the_slices(monkeypatch):
    rng = random.Random(10)
    texts = [" ".join("x" * rng.randrange(1, 30) for _ in range(200)) for _ in range(20)]
    whole = shingles.shingle_sets(texts, 3)
    monkeypatch.setattr(shingles, "SLICE", 500)
    shingles.powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(texts, 3), strict=True))
    shingles.powers.cache_clear()


def test_stored_steps_hand_few_rows_at_once_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    found = [r["n"] for r in shared.stored(spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "n bigint"), "sizes").collect()]
    assert sum(found) == 5_000 and max(found) <= shared.ARROW_ROWS
    assert spark.conf.get(name) == before
