"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled texts: a word counts once for each word that it follows, so
that copies of a text say no more than the text itself, and words and stems that come in toxic texts
far more often than chance allows are kept. Every text is read once for its features. Trees are learned on
some folds, the calibration on another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import Rows, documents, fold, picked, stored, without

#: Labelled rows that are learned from, about; others are left out by a hash of the id.
LABEL_ROWS = 20_000
#: Words of the lexicon, and the least evidence (log likelihood ratio) for one.
LEXICON_WORDS = 400
LEAST_EVIDENCE = 12.0
TREES, DEPTH, RATE = 20, 3, 0.3
#: Lengths of the stems that stand for all longer words which begin so.
STEMS = (4, 5, 6)
#: The fold that the calibration learns from; fold 0 is held out, the others make the trees.
CALIBRATION_FOLD = 1
#: Word pairs that a task holds before it hands them on, and words whose evidence a worker keeps.
PAIRS_HELD, WORDS_KEPT = 50_000, 100_000
#: Words around a lexicon word in which a second person counts as near, and of a dense stretch.
NEAR, STRETCH = 5, 25

#: Pronouns of the second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros".split()
)
#: Letters that digits and signs stand for.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[\d@$*!._-]++[^\W\d_][\w@$*!]*")  # linear in the length of the text
STRETCHED = re.compile(r"([^\W\d_])\1\1")

FEATURES = (
    "hits",
    "hit_rate",
    "dense_hits",
    "best_hit",
    "evidence_rate",
    "near_second_person",
    "hidden_hits",
    "capitals",
    "shouted_words",
    "exclamations",
    "questions",
    "other_signs",
    "mixed_words",
    "stretched_words",
    "log_words",
)
ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((f, pa.float64()) for f in FEATURES)])
SCHEMA = "doc_id bigint, text_hash bigint, " + ", ".join(f"{f} double" for f in FEATURES)


def stems(word: str) -> list[str]:
    """The stems of a word, marked by a star."""
    return [f"{word[:k]}*" for k in STEMS if len(word) > k]


def word_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, word before, word or stem) of labelled texts; a row comes once per ``PAIRS_HELD`` of them, or more often."""
    schema = pa.schema([("toxic", pa.int32()), ("before", pa.string()), ("word", pa.string())])
    seen: set[tuple[int, str, str]] = set()

    def flush() -> pa.RecordBatch:
        columns = zip(*seen, strict=True) if seen else [()] * 3
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        seen.clear()
        return batch

    for batch in batches:
        for toxic, text in zip(batch.column("toxic"), batch.column("text"), strict=True):
            before, label = "", toxic.as_py()
            for match in WORD.finditer((text.as_py() or "").lower()):
                word = match[0]
                seen.add((label, before, word))
                for stem in stems(word):
                    seen.add((label, before, stem))
                before = word
                if len(seen) >= PAIRS_HELD:
                    yield flush()
    yield flush()


def learn_lexicon(labelled: DataFrame, *, most: int = LEXICON_WORDS, least: float = LEAST_EVIDENCE) -> dict[str, float]:
    """The words whose contexts are in toxic texts far more often than chance, each with its evidence."""
    pairs = labelled.select("toxic", "text").mapInArrow(word_pairs, "toxic int, before string, word string").distinct()
    counts = pairs.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = stored(counts, "word-counts")
    whole = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not whole["t"] or not whole["c"]:
        return {}
    share = whole["t"] / (whole["t"] + whole["c"])
    n = F.col("t") + F.col("c")
    clean = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
    evidence = F.col("t") * F.log(F.col("t") / (n * share)) + clean
    toxic = counts.filter((F.col("t") > 2) & (F.col("t") / n > 0.5)).withColumn("evidence", evidence)
    best = toxic.filter(F.col("evidence") >= least).orderBy(F.desc("evidence"), "word").limit(most)
    return {r["word"]: r["evidence"] for r in best.collect()}


class Evidence(dict):
    """The evidence of a word or its best stem, 0 for words without any; looked up once per distinct word."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        #: How the words and stems begin: no other word has any evidence.
        self.starts = {word.rstrip("*")[: STEMS[0]] for word in lexicon}

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        find = self.lexicon.get
        found = self[word] = max([find(word, 0.0), *(find(s, 0.0) for s in stems(word))])
        return found


def dense_features(text: str, lexicon: dict[str, float] | Evidence) -> tuple[float, ...]:
    """The features of one text; rates are per word or per character. All are 0 for the empty text.

    ``lexicon`` has the evidence of each word and stem.
    """
    known = lexicon if isinstance(lexicon, Evidence) else Evidence(lexicon)
    lower = text.lower()
    found = WORD.findall(lower)
    words, chars = max(1, len(found)), max(1, len(text))
    starts, first = known.starts, STEMS[0]
    hits = [i for i, w in enumerate(found) if w[:first] in starts and known[w]]
    evidence = [math.log1p(known[found[i]]) for i in hits]
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(found[max(0, i - NEAR) : i + NEAR + 1]))
    dense = lo = 0
    for hi, at in enumerate(hits):
        while at - hits[lo] > STRETCH:
            lo += 1
        dense = max(dense, hi - lo + 1)
    mixed = MIXED.findall(lower)
    hidden = sum(1 for w in mixed if w.translate(STAND_INS).replace(".", "").replace("-", "").replace("_", "") in known.lexicon)
    signs = {c: text.count(c) for c in "!?*#$%&@"}
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b", text))
    return (
        math.log1p(len(hits)),
        len(hits) / words,
        float(dense),
        max(evidence, default=0.0),
        sum(evidence) / words,
        near / words,
        math.log1p(hidden),
        upper / chars,
        shouted / words,
        signs["!"] / chars,
        signs["?"] / chars,
        sum(signs[c] for c in "*#$%&@") / chars,
        len(mixed) / words,
        len(STRETCHED.findall(lower)) / words,
        math.log1p(len(found)),
    )


def feature_table(df: DataFrame, lexicon: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the features of every whole text; the lexicon has a fixed bound."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = Evidence(shared.value), Rows(ARROW, most=10_000)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
            for doc_id, text_hash, text in zip(*columns, strict=True):
                if rows.add(doc_id, text_hash, *dense_features(text or "", own)):
                    yield rows.take()
        yield rows.take()

    return picked(df, id_col, text_col).mapInArrow(run, SCHEMA)


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and toxic (1 if any label says so) of at most about ``most`` ids outside fold 0."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    share = min(1.0, most / max(1, known.count()))
    return stored(known.filter(draw < share).repartition(1), "labels")


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    *,
    label_rows: int = LABEL_ROWS,
    lexicon_words: int = LEXICON_WORDS,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """Learn from labelled rows outside fold 0 and score every row of ``df``.

    One row per row: doc_id, held_out, score (0 to 1), predicted, and text_hash to tell apart rows that repeat an id. NULL texts are scored as the empty
    text. Where no row or only one class is labelled, the score is the share of toxic labels.
    Repeated rows yield a row each; other columns are not read.
    """
    docs = df.select("doc_id", "text")
    sample = F.broadcast(labelled_sample(labels, label_rows))  # bounded by label_rows
    lexicon = learn_lexicon(docs.join(sample, "doc_id"), most=lexicon_words)
    features = stored(feature_table(docs, lexicon), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    rows = rows.select("doc_id", "text_hash", "features")
    train = stored(features.join(sample, "doc_id").repartition(4), "train")
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    train = train.select("features", F.col("toxic").cast("double").alias("label"), fold().alias("fold"))
    makes, calibrates = train.filter(F.col("fold") != CALIBRATION_FOLD), train.filter(F.col("fold") == CALIBRATION_FOLD)
    out = ["doc_id", (fold() == 0).alias("held_out"), "text_hash"]

    def classes(part: DataFrame) -> tuple[int, float]:
        found = part.agg(F.countDistinct("label").alias("n"), F.avg("label").alias("mean")).first()
        return found["n"], found["mean"] or 0.0

    kinds, mean = classes(makes)
    if kinds < 2:
        return rows.select(*out, F.lit(mean).alias("score"), F.lit(int(mean >= 0.5)).alias("predicted"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=RATE).fit(makes)
    raw = vector_to_array("probability")[1].alias("raw")
    scored = model.transform(rows).select("doc_id", "text_hash", raw)
    if classes(calibrates)[0] == 2:
        held = model.transform(calibrates).select("label", raw)
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
        scored = steps.transform(scored)
    else:
        scored = scored.withColumn("score", F.col("raw"))
    score = F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("score")
    return scored.select(*out, score, (F.coalesce("score", F.lit(0.0)) >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with all their columns."""
    found = toxicity(df, labels, **limits)
    return without(df, found.filter("predicted = 1"), "doc_id", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")
