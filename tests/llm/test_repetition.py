"""Repeats against a brute-force version that compares every pair of places in a text."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

from roadgrain.llm import repetition
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, longest_repeat."""
    words = WORD.findall(text or "")
    n = len(words)
    same = [[0] * (n + 1) for _ in range(n + 1)]
    covered, windows, longest = set(), set(), 0
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, i, -1):
            if words[i] == words[j]:
                size = same[i][j] = same[i + 1][j + 1] + 1
                for at, k in ((windows, 8), (covered, least)):
                    if size >= k:
                        at.update(range(i, i + k), range(j, j + k))
                longest = max(longest, size)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(windows),
        len(covered), longest if longest >= least else 0,
    )


def made(rng, size, letters):
    return "".join(rng.choices(letters, k=size))


@pytest.mark.parametrize("least", [1, 3, 5, 8, 11])
def test_measures_equal_brute_force(least):
    rng = random.Random(least)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(60))) for _ in range(30)]
    texts += [made(rng, rng.randrange(150), "ab #*\n\t\x0b\x1cé ") for _ in range(60)]
    texts += ["", "a " * 40, "a b c " * 30, "x\n" * 9, " ".join(map(str, range(50))) + "\n" + " ".join(map(str, range(30, 50)))]
    words = [t.encode().split() for t in texts]
    found = repetition.measure(texts, words, least)
    assert [f[:7] for f in found] == [brute(t, least) for t in texts]
    for (*_, covered, _, _, spans), own in zip(found, words, strict=True):
        assert sum(b - a for a, b in spans) == covered and all(0 <= a < b <= len(own) for a, b in spans)


def test_maximal_repeats_are_counted_once_per_place():
    text = "p q r s t u 1 p q r s t u 2 q r s t u"
    (*_, longest, repeats, spans), = repetition.measure([text], [text.encode().split()], 5)
    assert (longest, repeats, spans) == (6, 3, [(0, 6), (7, 13), (14, 19)])


def test_suffixes_are_sorted():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, 400)
    order, _ = repetition.sort_suffixes(keys, np.full(400, 400))
    assert order.tolist() == sorted(range(400), key=lambda i: keys[i:].tolist())


def test_odd_texts_rows_and_verdicts(odd):
    rows = repetition.judged(repetition.repetition(odd)).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(ODD_TEXTS):
        if text is None or len(text) < 1_000:
            assert brute(text, 5) in [tuple(r[c] for c in repetition.COUNTS[:7]) for r in by_id[i]]
    long = by_id[ODD_TEXTS.index("word " * 30_000)][0]
    assert long["n_repeat_words"] == long["n_covered_words"] == 30_000 and long["longest_repeat"] == 29_999
    assert not any(r["kept"] for r in rows)  # all are short or repeat


def test_verdict_limits(docs):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, few = fresh(51), fresh(6)
    texts = {
        1: fresh(200),
        2: f"{passage} {fresh(900)} {passage}",  # a long repeat, little covered
        3: f"{passage[: passage.rindex(' ')]} {fresh(900)} {passage[: passage.rindex(' ')]}",
        4: " ".join([few, *(f"{fresh(1)} {few}" for _ in range(9))]),  # short repeats, much covered
        5: fresh(19),
    }
    rows = {r["doc_id"]: r for r in repetition.judged(repetition.repetition(docs(texts.items()))).collect()}
    assert {i: r["kept"] for i, r in rows.items()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert {i: r["base_failed"] for i, r in rows.items()} == {1: False, 2: False, 3: False, 4: False, 5: True}


def test_nothing(empty):
    assert repetition.judged(repetition.repetition(empty)).count() == 0


def test_query_equals_its_sql(spark, docs, tmp_path):
    rng = random.Random(2)
    texts = [(i, made(rng, rng.randrange(400), "abc \n#")) for i in range(60)] + [(99, None), (3, "x"), (3, "x")]
    path = str(tmp_path / "documents.parquet")
    docs(texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path)
    found = repetition.op13_repetition_rules(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{path}/*.parquet'")
        want = db.execute(repetition.sql()).df()[found.columns].values.tolist()
    assert sorted(map(tuple, want)) == sorted(map(tuple, found.collect()))
