"""Tokens, shards and packing against the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadgrain.llm import lexicon, packing, wavelet, words
from roadgrain.llm.wavelet import WaveletMatrix


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(words.default_path())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_chunks_of_odd_texts_encode_like_the_library(library):
    from tests.llm.conftest import ODD_TEXTS

    own = words.chunk_ids(words.default_path())
    rng = random.Random(3)
    letters = "abcXYZéßÀ'’.,!?<|>-_0123456789²ªµ×÷ \t\n\x1c\x85\xa0 ΣςİΩ中é​"
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3_000)]
    for text in texts:
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_lexicon_encodes_and_decodes_like_the_library(spark, odd, library):
    found = lexicon.encode_documents(odd, keep_ids=True, least_count=1).collect()
    want = []
    for doc_id, text in rows_of(odd):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded))
    assert sorted(map(repr, want)) == sorted(
        repr((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"])) for r in found
    )
    assert sum(r["n_lexicon"] for r in found) > 30_000


def test_lexicon_of_nothing(empty):
    assert lexicon.encode_documents(empty).count() == 0


def test_automaton_holds_its_words_and_no_others():
    rng = random.Random(1)
    entries = {"".join(rng.choices("abcé", k=rng.randrange(1, 9))).encode(): packed([rng.randrange(99)] * rng.randrange(4)) for _ in range(2_000)}
    own = lexicon.Automaton(memoryview(lexicon.compile_automaton(list(entries.items()))))
    assert all(own.get(w) == ids for w, ids in entries.items())
    assert sorted(own.number(w) for w in entries) == list(range(len(entries)))
    assert all(own.get(w[:-1] + b"zz") is None for w in entries) and own.get(b"") is None
    assert len(own.final) < sum(map(len, entries))  # suffixes are shared
    assert lexicon.Automaton(memoryview(lexicon.compile_automaton([]))).get(b"a") is None


def test_merges_equal_the_library(library):
    own, rng = lexicon.merger(words.default_path()), random.Random(2)
    for _ in range(500):
        word = "".join(rng.choices("thenioaréßx", k=rng.randrange(1, 14)))
        assert own.word(word) == library.encode(word, add_special_tokens=False).ids


def test_long_words_merge_like_the_library_and_in_time(library):
    own, rng = lexicon.merger(words.default_path()), random.Random(12)
    for n in (1, 2, 40, 47, 48, 49, 60, 300, 4_000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "thé"):
            word = "".join(rng.choices(letters, k=n))
            assert own.word(word) == library.encode(word, add_special_tokens=False).ids
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    start = time.process_time()
    found = own.word(long)
    assert time.process_time() - start < 5
    assert found == library.encode(long, add_special_tokens=False).ids


def test_frequent_chunks_are_the_commonest(docs):
    counts = {f"w{i}": 4 + i for i in range(60)} | {"rare": 2}
    texts = [(1, " ".join(w for w, n in counts.items() for _ in range(n))), (2, "a " * 500)]
    all_ = {r["chunk"]: r["n"] for r in lexicon.frequent_chunks(docs(texts), "text", 1_000, 4).collect()}
    assert all_ == {w: n for w, n in counts.items() if n >= 4} | {"a": 500}
    some = {r["chunk"]: r["n"] for r in lexicon.frequent_chunks(docs(texts), "text", 30, 4).collect()}
    assert 20 <= len(some) <= 30 and min(some.values()) > max(n for w, n in all_.items() if w not in some)
    assert not lexicon.frequent_chunks(docs(texts), "text", 0, 4).collect()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 5_000])
def test_wavelet_matrix_against_a_plain_array(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 70_000 if n == 513 else 300, n).astype(np.uint32)
    own = WaveletMatrix.build(ids)
    assert np.array_equal(own.ids(), ids)
    at = rng.integers(0, n, 50) if n else np.empty(0, np.int64)
    assert np.array_equal(own.access(at), ids[at])
    for token in {*ids[:20].tolist(), 299, 12_345}:
        places = np.flatnonzero(ids == token)
        assert own.count(token) == len(places) and np.array_equal(own.occurrences(token), places)
        assert own.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())
        assert own.select(token, len(places)) == -1


@pytest.mark.parametrize("n", [0, 1, 512, 5_000])
def test_shard_file_stores_its_ranks(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    payload = wavelet.write_shard([None, 7], [n // 3, n - n // 3], ids)
    assert wavelet.shard_documents(payload) == ([None, 7], [n // 3, n - n // 3])
    built, own = WaveletMatrix.build(ids), wavelet.open_matrix(payload)
    assert (own.n, own.zeros, len(own.planes)) == (n, built.zeros, len(built.planes))
    for level in range(len(own.planes)):
        plain = np.unpackbits(own.planes[level].view(np.uint8), bitorder="little")
        ones = np.concatenate(([0], plain.cumsum()))[:-1]
        blocks, inner = own.ranks[level]
        assert blocks.tolist() == ones[:: wavelet.BLOCK].tolist()
        assert (blocks.repeat(wavelet.BLOCK // wavelet.WORD) + inner).tolist() == ones[:: wavelet.WORD].tolist()
        assert own.ones_before(level, np.arange(n + 1)).tolist() == [*ones, ones[-1] + plain[-1]][: n + 1]
    assert np.array_equal(own.between(0, n), ids) and np.array_equal(own.between(n // 3, n // 2), ids[n // 3 : n // 2])
    assert own.count(5) == int((ids == 5).sum()) and np.array_equal(own.occurrences(5), np.flatnonzero(ids == 5))
    with pytest.raises(ValueError, match="not a token shard"):
        wavelet.open_matrix(b"WVMX" + payload[4:])


def test_planes_are_unpacked_when_needed():
    opened = []
    some = wavelet.OnDemand(lambda i: opened.append(i) or i * 2, 4)
    assert some[1] == some[1] == 2 and opened == [1] and list(some) == [0, 2, 4, 6] and some[-1] == 6


def test_shards_read_back(spark, odd, library, tmp_path):
    wavelet.write_shards(odd, str(tmp_path / "s"), shard_tokens=20_000)
    shards = spark.read.parquet(str(tmp_path / "s"))
    assert shards.count() > 2
    found = wavelet.read_documents(shards).orderBy("start").collect()
    texts = sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [d for d, _ in texts]
    at, want = 0, {}
    for doc_id, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(packed(ids))))
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    assert wavelet.count_tokens(shards, 1).agg({"n": "sum"}).first()[0] == len(texts)


def test_shards_of_nothing(spark, empty, tmp_path):
    wavelet.write_shards(empty, str(tmp_path / "s"))
    assert wavelet.read_documents(spark.read.schema(wavelet.SHARDS).parquet(str(tmp_path / "s"))).count() == 0


def check_packing(pieces, texts, library, longest=4096):
    """Every id is in one piece, sequences are gapless, and none needs padding."""
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        documents.setdefault(p["doc_id"], []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        total = sum(p["length"] for p in own)
        assert total == own[0]["tier"] <= longest and total & (total - 1) == 0
    want = sorted(packed(library.encode(t, add_special_tokens=False).ids + [2]) for _, t in texts)
    assert sum(p["length"] for p in pieces) == sum(map(len, want)) // 4
    by_id = {}
    for doc_id, text in texts:
        by_id.setdefault(doc_id, []).append(packed(library.encode(text, add_special_tokens=False).ids + [2]))
    for doc_id, datas in by_id.items():
        if len(datas) > 1:
            continue
        at = 0
        for p in sorted(documents[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(datas[0]) // 4
            assert p["ids_crc32"] == zlib.crc32(datas[0][4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(datas[0]) // 4


def test_packing_places_every_token_once(odd, library):
    check_packing(packing.pack_documents(odd).collect(), rows_of(odd), library)


def test_packing_in_small_blocks_and_tiers(docs, library):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["the", "cat", "antidisestablishmentarianism", "x1"], k=rng.randrange(300)))) for i in range(200)]
    found = packing.pack_documents(docs(texts), tiers=(16, 64, 128), block_tokens=2_000).collect()
    check_packing(found, texts, library, 128)
    # One task's share of the rows: with 128 and more tokens a block each tier has documents of its own size.
    own = words.chunk_ids(words.default_path())
    end = packed([2])
    lengths = [10] * 40 + [60] * 40 + [200] * 10
    rows = [(i, own.encode(" ".join(["the"] * (n - 1))) + end) for i, n in enumerate(lengths)]
    for part in (0, 3):
        batches = packing.pack_partition(iter(rows), part, (16, 64, 128), 1_000)
        pieces = [p for batch in batches for p in batch.to_pylist()]
        assert sum(p["length"] for p in pieces) == sum(lengths)
        assert {16, 64, 128} <= {p["tier"] for p in pieces}
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack_documents(docs(texts), tiers=(100,))


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


def test_steps_are_balanced():
    rng = random.Random(6)
    windows = []
    for _ in range(64):
        cuts = sorted(rng.sample(range(1, 512), rng.randrange(6)))
        windows.append(packing.Window(512, [packing.Piece(0, a, b - a) for a, b in zip([0, *cuts], [*cuts, 512], strict=True)]))
    steps = packing.balanced_steps(windows, 8)
    costs = {}
    for w, s in zip(windows, steps, strict=True):
        costs.setdefault(s, []).append(sum(p.length**2 for p in w.pieces))
    assert all(len(c) == 8 for c in costs.values())
    assert max(map(sum, costs.values())) < 1.3 * min(map(sum, costs.values()))
