"""The pipeline: each stage on what the one before it kept, held against brute force."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from roadgrain.llm import jaccard, privacy, queries, toxicity, words
from roadgrain.llm.shared import documents, stored
from tests.llm.test_duplicates import brute_near

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns on the smallest tables."""
    docs, out = documents(spark, SF_DIR), []
    for _, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF_DIR), "test")
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns_of_documents(spark, kept):
    columns = documents(spark, SF_DIR).columns
    assert all(out.columns == columns for _, out in kept[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near duplicates", "personal data", "packing"]


def test_toxic_documents_go(spark, kept):
    docs, out = kept[0]
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    clean = {r["doc_id"] for r in scores if r["predicted"] == 0}
    assert {i for i, _ in rows(out)} == clean and len(clean) > 0.8 * docs.count()


def test_exact_copies_go(kept):
    docs, out = kept[1]
    least = {}
    for doc_id, text in rows(docs):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        least[norm] = min(least.get(norm, doc_id), doc_id)
    assert {i for i, _ in rows(out)} == set(least.values())


def test_near_copies_go(kept):
    docs, out = kept[2]
    texts = rows(docs)
    least = [eval(r) for r in brute_near(texts, corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_PERCENT)]  # noqa: S307
    assert {i for i, _ in rows(out)} == {component for _, _, component in least}


def test_personal_data_goes(kept):
    docs, out = kept[3]
    before, after = dict(rows(docs)), dict(rows(out))
    assert before.keys() == after.keys()
    assert any(privacy.base_spans(t) for t in before.values())
    assert all(not [s for s in privacy.base_spans(t) if s.kind == "email"] for t in after.values())
    same = [i for i, t in before.items() if not privacy.base_spans(t)]
    assert all(before[i] == after[i] for i in same)
    assert all(r["n_chars"] == len(r["text"]) for r in out.select("n_chars", "text").collect())


def test_everything_left_is_packed(kept):
    docs, out = kept[4]
    encode = words.chunk_ids(words.default_path()).encode
    want = sum(len(encode(t or "")) // 4 + 1 for _, t in rows(docs))
    assert out.agg({"length": "sum"}).first()[0] == want


def test_the_whole_run_equals_the_stages(spark, kept):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.columns == kept[-1][1].columns
    assert found.agg({"length": "sum"}).first() == kept[-1][1].agg({"length": "sum"}).first()


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(contract.oracle_sql())


def test_the_smallest_documents_have_near_duplicates_like_brute_force(spark):
    docs = documents(spark, SF_DIR)
    found = jaccard.near_duplicates(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute_near(rows(docs), 3, 90)
