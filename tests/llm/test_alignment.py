"""Alignment against a brute-force version: common ends of tokens, and all pairs between them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from roadgrain.llm import alignment
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def known():
    return alignment.vocabularies(*alignment.default_paths())


def spans(ids, names):
    found, at = [], 0
    for i in ids:
        found.append((at := at + len(names[i]), i))
    return found


def brute(texts, known):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, linked = [], []
    for text in texts:
        encoded = known.encode(text) if text else None
        a, b = [x.tolist() for x in encoded] if encoded else ([], [])
        ends_a, ends_b = spans(a, known.a_bytes), spans(b, known.b_bytes)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({e for e, _ in ends_a} & {e for e, _ in ends_b}):
            own_a, own_b = [], []
            while i < len(ends_a) and ends_a[i][0] <= cut:
                own_a.append(ends_a[i][1])
                i += 1
            while j < len(ends_b) and ends_b[j][0] <= cut:
                own_b.append(ends_b[j][1])
                j += 1
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            links += [(x, y) for x in own_a for y in own_b]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append([len(a), len(b), len(groups), len(links), sha])
        linked.append(Counter(links))
    counts = Counter(p for own in linked for p in own)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for row, own in zip(rows, linked, strict=True):
        row[4:4] = [sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(counts[p] * n for p, n in own.items())]
    return [tuple(r) for r in rows]


def found_rows(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r["doc_id"] is None, r["doc_id"], *[r[c] for c in names]) for r in df.collect())


def want_rows(df, known):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    return sorted((i is None, i, *own) for (i, _), own in zip(rows, brute([t for _, t in rows], known), strict=True))


@pytest.mark.parametrize("hot_pairs", [1, 20_000])
def test_alignment_equals_brute_force(docs, known, hot_pairs):
    rng = random.Random(4)
    words = ["the", "unbelievable", "naïve", "Straße", "中文字", "😀", "x1", "…", "don't", "ﬁn", "a▁b", "  ", "\n\n", "<|endoftext|>", "</s>"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(120)]
    df = docs(texts)
    assert found_rows(alignment.align(df, hot_pairs=hot_pairs)) == want_rows(df, known)


def test_odd_texts_and_repeated_rows(odd, known):
    assert found_rows(alignment.align(odd)) == want_rows(odd, known)


def test_small_parts_and_wide_groups(known, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 200)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 2)
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 160_000]
    found = alignment.align_texts(texts, known)
    want = brute(texts, known)
    assert [(f.n_a, f.n_b, f.n_groups, f.n_links, f.sha.hexdigest() if f.n_groups else "") for f in found] == [(*w[:4], w[6]) for w in want]
    assert all(int(f.times.sum()) == f.n_links and len(set(f.pairs.tolist())) == len(f.pairs) for f in found)


def test_ids_are_those_of_the_library(known):
    rng = random.Random(8)
    letters = "abcXYZéßÀ'’.,!?<|>-_0123456789²ªµ÷ \t\n\x1c\x85\xa0 ΣİΩ中é​'s'll"
    texts = [t for t in ODD_TEXTS if t] + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(3_000)]
    assert known.ranked is not None and known.cuts
    for text in texts:
        want = known.a.encode(" " + text, add_special_tokens=False).ids
        assert known.ranked.encode_ordinary(" " + text) == want, text[:80]
        parts = list(known.parts(text))
        assert [i for p in parts for i in known.a.encode(" " + p, add_special_tokens=False).ids] == want


def test_groups_break_where_both_end_a_token(known):
    import numpy as np

    a, b = alignment.groups_of(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert (a.tolist(), b.tolist()) == ([0, 1, 1], [0, 0, 1])


def test_texts_that_a_tokenizer_changes_have_no_tokens(docs):
    row = alignment.align(docs([(1, "a ▁ b")])).first()
    assert (row["n_a"], row["n_b"], row["n_links"], row["groups_sha256"]) == (0, 0, 0, "")


def test_nothing(empty):
    assert alignment.align(empty).count() == 0
