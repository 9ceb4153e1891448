"""Language identification by language-bitmask n-gram filters.

Each language puts its commonest letter trigrams into one Bloom filter whose slots are bit masks:
bit l of a slot stands for language l, so the slots of a trigram, taken together with AND, name all
languages that contain it. A text's trigrams are counted per language; the counts are corrected for
the false positives that the fill of a language's bits leads to expect.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm.shared import Rows, documents, fold, text_rows

#: Labelled documents per language that are learned from, about; the rest of a language's rows are left out by a hash of the id.
SAMPLE_DOCS = 2_000
#: Trigrams that a language puts into the filter.
TOP_GRAMS = 3_000
#: Slots of the filter and places per trigram.
SLOT_BITS = 18
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Characters whose trigrams are held at a time.
SLICE = 1 << 20
UNKNOWN = "und"

SCHEMA = "doc_id bigint, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(texts: Iterable[str]) -> np.ndarray:
    """Lower-cased code points, 0 for what is no letter and at the ends of each text."""
    joined = "\0" + "\0".join(t.lower() for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letter_table()[points], points, 0).astype(np.int64)


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slice by slice: its start, the places of letters in it and the trigram around each letter."""
    for start in range(1, len(points) - 1, SLICE):
        end = min(start + SLICE, len(points) - 1)
        middle = points[start:end]
        at = np.flatnonzero(middle)
        gram = (points[start - 1 : end - 1][at] << 42) | (middle[at] << 21) | points[start + 1 : end + 1][at]
        yield start, at + start, gram


def slots(gram: np.ndarray) -> list[np.ndarray]:
    mixed = gram.astype(np.uint64)
    mixed = mixed ^ (mixed >> np.uint64(31))
    return [((mixed * np.uint64(p)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for p in PLACES]


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: ``words[k]`` holds the bits of languages 64 k to 64 k + 63."""

    langs: list[str]
    words: np.ndarray

    @classmethod
    def build(cls, langs: list[str], by_lang: dict[str, np.ndarray]) -> LanguageFilter:
        words = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), np.uint64)
        for number, lang in enumerate(langs):
            for places in slots(by_lang[lang]):
                words[number // 64, places] |= np.uint64(1 << (number % 64))
        return cls(langs, words)

    @cached_property
    def false_rates(self) -> np.ndarray:
        """The chance of each language to hold a trigram that it never took in."""
        fill = [((self.words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.langs))]
        return np.array(fill) ** len(PLACES)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        first, *rest = slots(gram)
        found = self.words[:, first]
        for places in rest:
            found &= self.words[:, places]
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and how many of them each language holds."""
        points = codes(texts)
        # the code points of text i lie between the separators i and i + 1
        ends = np.cumsum([1, *(len(t.lower()) + 1 for t in texts)])
        total = np.zeros(len(texts), np.int64)
        held = np.zeros((len(texts), len(self.langs)), np.int64)
        for _, at, gram in grams(points):
            doc = np.searchsorted(ends, at, side="right") - 1
            total += np.bincount(doc, minlength=len(texts))
            masks = self.masks(gram)
            for k in range(len(self.langs)):
                bit = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                held[:, k] += np.bincount(doc[bit.view(np.int64) == 1], minlength=len(texts))
        return total, held

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text and its share of the corrected counts.

        Texts without a letter are ``und`` with score 0. Ties go to the language that comes first;
        a text with no known trigram gets that one, too, with score 0.
        """
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        total, held = self.counts(texts)
        rates = np.minimum(self.false_rates, 0.999)
        corrected = np.maximum(0.0, (held - total[:, None] * rates) / (1 - rates))
        best, whole = corrected.argmax(axis=1), corrected.sum(axis=1)
        return [
            (UNKNOWN, 0.0) if not n else (self.langs[b], float(row[b] / w) if w > 0 else 0.0)
            for n, b, w, row in zip(total, best, whole, corrected, strict=True)
        ]


def in_slices(rows: Iterable[tuple[object, str]], most: int = SLICE) -> Iterator[list[tuple[object, str]]]:
    """Rows in groups of about ``most`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for row in rows:
        if group and size + len(row[1]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1])
    if group:
        yield group


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in in_slices(text_rows(batches, "lang", "text")):
        for lang in sorted({k for k, _ in group}):
            for _, _, gram in grams(codes(t for k, t in group if k == lang)):
                kinds, n = np.unique(gram, return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(n)], schema=GRAMS)


def learn(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS) -> LanguageFilter:
    """The filter of labelled rows (doc_id, lang, text).

    What comes to the driver is bounded by ``top_grams`` for each language.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageFilter.build([], {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= top_grams).select("lang", "gram").collect()
    by_lang: dict[str, list[int]] = {}
    for r in top:
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    langs = sorted(by_lang)
    return LanguageFilter.build(langs, {k: np.array(v, np.int64) for k, v in by_lang.items()})


def identify(df: DataFrame, known: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred, score. The filter has a fixed size and is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for group in in_slices(text_rows(batches, "doc_id", "text")):
            rows = Rows(ARROW)
            for (doc_id, _), (lang, score) in zip(group, own.predict([t for _, t in group]), strict=True):
                rows.add(doc_id, lang, score)
            yield rows.take()

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def language_id(df: DataFrame, *, sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS) -> DataFrame:
    """Learn from the rows of ``documents`` outside fold 0 that have a language; predict all rows.

    One row per row: doc_id, held_out, lang_pred, score. NULL texts and texts without a letter are
    ``und`` with score 0; so is every text where no language is known. Repeated rows yield a row
    each; an empty table yields none; other columns are not read.
    """
    labelled = df.filter(F.col("lang").isNotNull() & (fold() != 0)).select("doc_id", "lang", "text")
    found = identify(df, learn(labelled, sample_docs=sample_docs, top_grams=top_grams))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
