"""Language and toxicity: held-out accuracy on planted corpora, odd rows, filters by hand."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadgrain.llm import language, toxicity

SYLLABLES = {"aa": "ka to mi su re no".split(), "bb": "sch ein der ung ach lich".split(), "cc": "oi eau que les tre ment".split()}


def text_in(rng, lang, words=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def speech(docs):
    rng = random.Random(1)
    truth = {i: rng.choice(["aa", "bb", "cc"]) for i in range(300)}
    df = docs([(i, text_in(rng, lang)) for i, lang in truth.items()])
    known = F.create_map(*[F.lit(x) for pair in truth.items() for x in pair])
    return df.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, known[F.col("doc_id").cast("int")])), truth


def test_language_of_held_out_texts(speech):
    df, truth = speech
    found = language.language_id(df).collect()
    assert len(found) == 300
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    out = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_language_does_not_depend_on_what_a_row_says_of_itself(speech):
    df, _ = speech
    known = language.learn(df.filter("lang is not null").select("doc_id", "lang", "text"))
    a = language.identify(df, known).collect()
    b = language.identify(df.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), known).collect()
    assert sorted(a) == sorted(b)


def test_language_of_odd_rows(odd, empty, speech):
    assert language.language_id(empty).count() == 0
    df, _ = speech
    found = language.language_id(df.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit(None)))).collect()
    by_id = {r["doc_id"]: r for r in found if (r["doc_id"] or 0) >= 1000}
    assert {r["lang_pred"] for r in found} <= {"aa", "bb", "cc", "und"}
    assert all(by_id[1000 + i]["lang_pred"] == "und" and by_id[1000 + i]["score"] == 0 for i in (0, 1, 2))
    assert by_id[1008]["lang_pred"] != "und"
    none = language.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_filter_names_the_languages_of_a_trigram():
    rng = np.random.default_rng(3)
    langs = [f"l{k:03}" for k in range(70)]  # more than one mask
    by_lang = {lang: rng.integers(1, 1 << 62, 50) for lang in langs}
    own = language.LanguageFilter.build(langs, by_lang)
    for number, lang in enumerate(langs):
        masks = own.masks(by_lang[lang])
        assert np.all((masks[number // 64] >> np.uint64(number % 64)) & np.uint64(1))
    strange = own.masks(rng.integers(1, 1 << 62, 20_000))
    assert np.bitwise_count(strange).sum() < 50
    assert np.all(own.false_rates < 1e-6)


def test_counts_equal_a_plain_count_and_do_not_depend_on_slices(monkeypatch):
    texts = ["Abc abd!", "", "x", "no LETTERS 123 no", "é ß Éa"]
    grams = []
    for t in texts:
        padded = "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
        grams.append([padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "\0"])
    chosen = sorted({g for gs in grams for g in gs})[::2]
    code = lambda g: (ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2])
    own = language.LanguageFilter.build(["q"], {"q": np.array([code(g) for g in chosen])})
    total, held = own.counts(texts)
    assert total.tolist() == [len(g) for g in grams]
    assert held[:, 0].tolist() == [sum(x in chosen for x in g) for g in grams]
    monkeypatch.setattr(language, "SLICE", 3)
    assert own.counts(texts)[1].tolist() == held.tolist()


@pytest.fixture(scope="module")
def talk(docs, spark):
    rng = random.Random(2)
    bad = ["glorp", "znark", "wubble"]
    rows, labels = [], []
    for i in range(600):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('xyzuv')}{rng.randrange(30)}".replace("1", "o").replace("2", "e") for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), {i: i % 6 == 0 for i in range(600)}


def test_toxic_texts_are_told_from_clean_ones(talk):
    df, labels, truth = talk
    found = toxicity.toxicity(df, labels, trees=4).collect()
    assert len(found) == 600
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    out = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_toxicity_of_odd_rows_and_missing_labels(odd, empty, talk, spark):
    _, labels, _ = talk
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    scored = toxicity.toxicity(odd, one).collect()
    assert {r["score"] for r in scored} == {1.0} and len(scored) == odd.count()


def test_features_of_one_text():
    own = dict(zip(toxicity.FEATURES, toxicity.dense_features("You are a MORON!! m0ron sooo", {"moron": 20.0}), strict=True))
    assert own["near_second_person"] > 0 and own["hidden_hits"] > 0 and own["stretched_words"] > 0
    assert own["exclamations"] == 2 / 28 and own["dense_hits"] == 1 and own["best_hit"] > 3 and own["shouted_words"] > 0
    assert set(toxicity.dense_features("", {})) == {0.0}


def test_stems_stand_for_longer_words():
    assert toxicity.stems("glorping") == ["glor*", "glorp*", "glorpi*"] and toxicity.stems("glor") == []
    own = dict(zip(toxicity.FEATURES, toxicity.dense_features("a glorping b glor glorpx", {"glorp*": 20.0}), strict=True))
    assert own["hit_rate"] == 2 / 5


def brute_lexicon(rows, least):
    """Evidence per word and stem, from sets of (label, word before, word) over all rows."""
    import math
    import re

    pairs = set()
    for toxic, text in rows:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        for before, word in zip(["", *found], found, strict=False):
            pairs |= {(toxic, before, w) for w in [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]}
    t, c = (sum(p[0] == label for p in pairs) for label in (1, 0))
    share, scores = t / (t + c), {}
    for word in {p[2] for p in pairs}:
        a, b = (sum(p[0] == label and p[2] == word for p in pairs) for label in (1, 0))
        if a > 2 and a / (a + b) > 0.5:
            score = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0)
            if score >= least:
                scores[word] = score
    return scores


@pytest.mark.parametrize("held", [3, 50_000])
def test_lexicon_equals_brute_force_however_often_pairs_are_handed_on(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "PAIRS_HELD", held)
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdeöF", k=5)) for _ in range(300)] + ["a1b"]
    rows = []
    for i in range(60):
        bad = rng.choices(["insulting", "insults", "Zonk"], k=8 if i % 3 == 0 else 1)
        words = rng.choices(plain, k=30) + bad
        rng.shuffle(words)
        rows.append((int(i % 3 == 0), " ".join(words)))
    rows += [(1, None), (0, ""), rows[0]]
    assert list(toxicity.word_pairs([pa.record_batch([pa.array([1]), pa.array(["a b"])], names=["toxic", "text"])]))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"), least=1.0)
    want = brute_lexicon(rows, 1.0)
    assert found.keys() == want.keys() and want and all(abs(found[w] - want[w]) < 1e-9 for w in want)


def brute_features(text, lexicon):
    """The features that are counts of words, word by word."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    score = lambda w: max([lexicon.get(w, 0), *(lexicon.get(f"{w[:k]}*", 0) for k in (4, 5, 6) if len(w) > k)])
    hits = [i for i, w in enumerate(words) if score(w)]
    near = sum(any(words[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), min(len(words), i + 6))) for i in hits)
    dense = max((sum(0 <= j - i <= 25 for j in hits) for i in hits), default=0)
    return len(hits) / max(1, len(words)), dense, near / max(1, len(words))


def test_features_equal_brute_force_also_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_KEPT", 3)
    rng = random.Random(6)
    lexicon = {"moron": 9.0, "idio*": 4.0, "x": 2.0}
    known = toxicity.Evidence(lexicon)
    for _ in range(200):
        text = " ".join(rng.choices(["you", "Moron", "idiotic", "idio", "fine", "x", "words", "du", "1"], k=rng.randrange(80)))
        own = dict(zip(toxicity.FEATURES, toxicity.dense_features(text, known), strict=True))
        assert (own["hit_rate"], own["dense_hits"], own["near_second_person"]) == brute_features(text, lexicon)


def test_copies_do_not_make_lexicon_words(spark):
    """Words of one toxic text in a hundred copies have one context each; the planted word has many."""
    copies = [(1, "grumpf lives beside frotz under the plonk")] * 100
    plants = [(1, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} zonk v") for i in range(30)]
    clean = [(0, f"{'abcdefghij'[i % 10]}x {'abcdefghij'[i // 10]}y the v lives") for i in range(100)]
    df = spark.createDataFrame([*copies, *plants, *clean], "toxic int, text string")
    assert toxicity.learn_lexicon(df).keys() == {"zonk"}
