"""The manifest against a plain tree in Python and against its SQL."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from roadgrain.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout=2):
    """Root, and per node the (left, right) siblings of each level."""
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, at in zip(steps, places, strict=True):
            head = at // fanout * fanout
            own.append(("".join(nodes[head:at]), "".join(nodes[at + 1 : head + fanout])))
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        places = [p // fanout for p in places]
    return nodes[0], steps


def want_rows(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    branches = {}
    for row in rows:
        branches.setdefault(row[2], []).append(row)
    names = sorted(branches, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for name in names:
        leaves = sorted((r[0] is not None, r[0] or 0, digest(*map(told, r)), r) for r in branches[name])
        own[name] = (leaves, *tree([x[2] for x in leaves], fanout))
    root, above = tree([own[n][1] for n in names], fanout)
    found = []
    for name, up in zip(names, above, strict=True):
        leaves, subroot, steps = own[name]
        for (_, _, leaf, row), first in zip(leaves, steps, strict=True):
            path = first + up
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = digest(*map(told, (*row[:3], None if row[3] is None else row[3] + 1, row[4])))
            for left, right in path:
                node = digest(left, node, right)
            found.append((repr(row[0]), leaf, subroot, root, digest(*(x for step in path for x in step)), node))
    return sorted(found)


def found_rows(df, **shape):
    rows = manifest.manifest(df, carry={"other": manifest.tampered(df)}, **shape)
    rows = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof(), manifest.folded("coalesce(other, leaf)"))
    return sorted((repr(r[0]), *r[1:]) for r in rows.collect())


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.fixture
def branched(docs):
    """Branches of 1 to 41 rows, one without a name, with NULLs and equal rows."""
    df = docs([(i * 3 % 97, f"text {i}") for i in range(90)] + [(5, "same"), (5, "same"), (5, None), (None, "x")])
    sized = F.when(F.col("doc_id") < 41, "en").when(F.col("doc_id") < 60, "ü").when(F.col("doc_id") == 96, "de").when(F.col("doc_id") < 70, "a|b")
    return df.withColumn("lang", sized).withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")))


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 1), (2, 2), (3, 2)])
def test_trees_of_several_tiers(branched, fanout, levels):
    assert found_rows(branched, fanout=fanout, levels=levels) == want_rows(plain(branched), fanout)


def test_odd_rows(odd):
    assert found_rows(odd) == want_rows(plain(odd))


def test_single_row_is_its_own_root(docs):
    row = manifest.manifest(docs([(1, None)])).select("*", manifest.proof().alias("proof")).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == digest()


def test_nothing(empty):
    assert manifest.manifest(empty).count() == 0


def test_query_equals_its_sql(spark, branched, tmp_path):
    path = str(tmp_path / "documents.parquet")
    branched.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = manifest.op12_merkle_manifest(spark, str(tmp_path)).select(*names).collect()
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{path}/*.parquet'")
        want = db.execute(manifest.sql()).df()[list(names)].astype(object).values.tolist()
    key = lambda r: (r[1], r[4])
    found, want = sorted(map(tuple, found), key=key), sorted(map(tuple, want), key=key)
    assert [r[1:] for r in found] == [r[1:] for r in want] and 0 < sum(not r[6] for r in found) < len(found)


def test_positions_number_a_branch_over_many_tasks(spark):
    rows = spark.range(5_000).select((F.col("id") % 3).alias("b"), F.hash("id").alias("o"), "id").repartition(7)
    placed = manifest.positions(rows, ["b"], ["o", "id"]).collect()
    for b in range(3):
        own = sorted(((r["o"], r["id"], r["pos"], r["n"]) for r in placed if r["b"] == b))
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
