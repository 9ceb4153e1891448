"""Quality rules on repetition inside a text, by a suffix array over its words.

The suffixes of many texts are sorted at once, by their first word, two words, four and so on; only
suffixes that still tie are sorted again. The ranks of those rounds give the longest common prefix of
neighbours in the suffix array. The deepest interval of common prefixes that a suffix lies in is the
longest repeat that starts there; repeats that no longer one contains are the maximal ones. A text is
kept if the union of their spans covers little of it and none of them is long.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import documents

#: Words of the least repeat that counts, per cent of the words that repeats may cover, words of the longest repeat allowed.
LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT = 5, 30, 50
#: The base rules' window, least words, and per cent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Words whose suffixes are sorted at once; a longer text is sorted on its own.
BATCH_WORDS = 200_000
SYMBOL = re.compile(r"[#*$%&|<>]")

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_covered_words", "longest_repeat", "n_repeats",
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("spans", SPANS)])
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", spans array<struct<start: bigint, end: bigint>>"


def sort_suffixes(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and per round the rank of each suffix by its first 1, 2, 4 ... words.

    ``keys`` are numbers of words, different between texts; ``ends`` has the end of the text that each
    word is in, so that suffixes end with their text. Equal ranks mean equal words, all within a text.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    composed, rounds, step = keys[order], [], 1
    while True:
        # A rank is 1 + the first slot of the suffixes that share it; the suffixes in ``slots`` are sorted anew.
        new = np.ones(len(slots), bool)
        new[1:] = composed[1:] != composed[:-1]
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = head + 1
        rounds.append(rank.astype(np.int32) if n < 2**31 else rank.copy())
        last = np.append(new[1:], True)
        slots = slots[~(new & last)]
        if not len(slots):
            return order, rounds
        at = order[slots]
        after = at + step
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)], 0)
        composed = rank[at] * (n + 1) + second
        again = np.argsort(composed, kind="stable")
        order[slots], composed = at[again], composed[again]
        step *= 2


def longest_repeats(keys: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest repeat of ``least`` words or more that starts there, else 0."""
    found = np.zeros(len(keys), np.int64)
    order, rounds = sort_suffixes(keys, ends)
    level = least.bit_length() - 1
    if level >= len(rounds):
        return found
    # Neighbours that share at least the largest power of two up to ``least``.
    near = np.flatnonzero(rounds[level][order[:-1]] == rounds[level][order[1:]])
    left, right = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (rounds[k][np.minimum(a, len(keys) - 1)] == rounds[k][np.minimum(b, len(keys) - 1)])
        common += same.astype(np.int64) << k
    enough = common >= least
    np.maximum.at(found, left[enough], common[enough])
    np.maximum.at(found, right[enough], common[enough])
    return found


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: list[str], words: list[list[bytes]], least: int) -> list[tuple]:
    """Per text the COUNTS and the spans of its repeats, as (start, end) in words."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((number[w] for own in words for w in own), np.int64, bounds[-1])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    ends = bounds[1:][text_of]
    reach = longest_repeats(text_of * max(1, len(number)) + ids, ends, min(least, WINDOW)) if len(ids) else ids
    starts = np.flatnonzero(reach >= least)
    hit = covered(starts, reach[starts], len(ids))
    windows = np.flatnonzero(reach >= WINDOW)
    repeated = covered(windows, reach[windows], len(ids))
    # A repeat that starts a word later and ends at the same word is part of the one before.
    stop = starts + reach[starts]
    maximal = np.ones(len(starts), bool)
    maximal[1:] = (starts[1:] != starts[:-1] + 1) | (stop[1:] > stop[:-1])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    span_start, span_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found = []
    for i, (text, own) in enumerate(zip(texts, words, strict=True)):
        lo, hi = bounds[i], bounds[i + 1]
        first, last = np.searchsorted(starts, (lo, hi))
        # A span may reach from one text into the next only by touching it.
        inside = slice(np.searchsorted(span_end, lo, "right"), np.searchsorted(span_start, hi))
        spans = [(int(max(a, lo) - lo), int(min(b, hi) - lo)) for a, b in zip(span_start[inside], span_end[inside], strict=True)]
        blank = sum(map(text.count, " \t\n\v\f\r"))
        found.append(
            (
                len(own), len(text) - blank, len(SYMBOL.findall(text)), repeated_lines(text), int(repeated[lo:hi].sum()),
                int(hit[lo:hi].sum()), int(reach[starts[first:last]].max(initial=0)), int(maximal[first:last].sum()), spans,
            )
        )
    return found


def measured_rows(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        while at < batch.num_rows:
            texts, words, n, start = [], [], 0, at
            while at < batch.num_rows and n < BATCH_WORDS:
                texts.append(batch.column("text")[at].as_py() or "")
                # White space of bytes is that of the contract, and no byte of a longer character is one.
                words.append(texts[-1].encode().split())
                n += len(words[-1])
                at += 1
            columns = zip(*measure(texts, words, least), strict=True)
            arrays = [pa.array(c, t.type) for c, t in zip(columns, list(ARROW)[1:], strict=True)]
            yield pa.record_batch([ids.slice(start, at - start), *arrays], schema=ARROW)


def repetition(df: DataFrame, *, least: int = LEAST_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, what the base rules count, and the repeats of ``least`` words or more.

    ``n_covered_words`` are the words in the union of all repeats, ``spans`` that union as (start, end)
    in words, ``longest_repeat`` the words of the longest one, ``n_repeats`` the maximal ones, each
    occurrence by itself. NULL and empty texts count nothing; a very long text is sorted on its own.
    Repeated rows yield a row each; other columns are not read. An empty table has no rows here.
    """
    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: measured_rows(batches, least), SCHEMA)


def judged(
    measured: DataFrame, *, most_covered: int = MOST_COVERED, longest: int = LONGEST_REPEAT
) -> DataFrame:
    """Add base_failed, and kept: whether neither the base rules nor the limits on repeats reject the text."""
    n, share = F.col("n_words"), lambda c: 100 * F.col(c)
    failed = (n < LEAST_WORDS) | (share("n_repeat_words") > MOST_REPEATED * n)
    fine = (share("n_covered_words") <= most_covered * n) & (F.col("longest_repeat") <= longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op13_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(repetition(documents(spark, sf_dir))).drop("spans", "n_repeats")


def sql() -> str:
    """The rules in SQL: windows of words stand for repeats of that many words or more.

    The longest repeat is the longest run of equal windows at a fixed distance. This writes out every pair
    of equal windows of a text, which only small tables allow.
    """
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    window = "array_to_string(words[p:p + {k} - 1], ' ')"

    def cover(k: int, name: str) -> str:
        own = window.format(k=k)
        return f"""
w{k} AS (
  SELECT row, p, {own} AS w FROM docs, unnest(range(1, n_words - {k} + 2)) AS t(p)
), {name} AS (
  SELECT row, count(DISTINCT q) AS n
  FROM (SELECT row, p, count(*) OVER (PARTITION BY row, w) AS times FROM w{k}), unnest(range(p, p + {k})) AS u(q)
  WHERE times > 1 GROUP BY row
)"""

    return rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {words} AS words, len({words}) AS n_words FROM documents
), {cover(WINDOW, "repeated")}, {cover(LEAST_REPEAT, "cover")},
same AS (
  SELECT row, a.p AS a, b.p AS b, {LEAST_REPEAT}::BIGINT AS size
  FROM w{LEAST_REPEAT} a JOIN w{LEAST_REPEAT} b USING (row, w) WHERE a.p < b.p
), runs AS (
  SELECT row, b - a AS apart, a, a - row_number() OVER (PARTITION BY row, b - a ORDER BY a) AS run FROM same
), longest AS (
  SELECT row, max(size) AS size FROM (SELECT row, count(*) + {LEAST_REPEAT} - 1 AS size FROM runs GROUP BY row, apart, run) GROUP BY row
), lines AS (
  SELECT row, sum(n - 1) AS n FROM (
    SELECT row, line, count(*) AS n FROM docs, unnest(string_split(text, chr(10))) AS t(line)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row, line
  ) GROUP BY row
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(cover.n, 0)::BIGINT AS n_covered_words,
  coalesce(longest.size, 0)::BIGINT AS longest_repeat,
  n_words < {LEAST_WORDS} OR 100 * coalesce(repeated.n, 0) > {MOST_REPEATED} * n_words AS base_failed,
  n_words >= {LEAST_WORDS} AND 100 * coalesce(repeated.n, 0) <= {MOST_REPEATED} * n_words
    AND 100 * coalesce(cover.n, 0) <= {MOST_COVERED} * n_words AND coalesce(longest.size, 0) <= {LONGEST_REPEAT} AS kept
FROM docs LEFT JOIN lines USING (row) LEFT JOIN repeated USING (row) LEFT JOIN cover USING (row) LEFT JOIN longest USING (row)
"""
