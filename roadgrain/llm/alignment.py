"""Alignment of two tokenizers over the same bytes.

Tokens of both are intervals of byte offsets. All of them are sorted by start, the running maximum of
the ends is taken, and a group breaks where a start reaches it, that is where both tokenizers end a
token. Within a group every token of one is linked with every token of the other. How often a pair of
ids is linked is counted over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import documents, stored
from roadgrain.llm.words import byte_letters

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Characters that are aligned at once; a longer text is cut between words, which both tokenizers keep apart.
BATCH_CHARS = 400_000
#: Groups with more links than this are counted by distinct ids instead of link by link.
WIDE_GROUP = 4_096
#: Pairs that are frequent enough to be sent to every task: those above this share of all counts, so at most so many.
HOT_PAIRS = 20_000
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
SEPARATORS = ("", ",", "|", ";")
#: Fixed value: where byte-level vocabularies split a text before merging.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ALIGNED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)
ALIGNED_SQL = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: i for i, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        #: No piece goes on after a space that follows a letter, so that a text may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        #: An id and what follows it, as text: four entries per id.
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([f"{i}{s}" for i in range(most) for s in SEPARATORS], object)
        self.ranked = ranked_merges(a_path, {b: i for i, b in enumerate(self.a_bytes)})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None where their bytes are not the space and the text."""
        raw = b" " + text.encode()
        if self.ranked is None:
            a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        else:
            a = self.ranked.encode_ordinary(" " + text)
        b = self.b.encode(text)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else None

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about BATCH_CHARS, cut at single spaces between words."""
        start = 0
        while self.cuts and len(text) - start > BATCH_CHARS and (cut := BETWEEN_WORDS.search(text, start + BATCH_CHARS)):
            yield text[start : cut.start()]
            start = cut.end()
        yield text[start:]


def ranked_merges(path: str, ids: dict[bytes, int]) -> tiktoken.Encoding | None:
    """The same vocabulary for a faster library, if its merges come in the order of the ids that they make."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = whole["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not plain or made != sorted(made):
        return None
    special = {t["id"] for t in whole["added_tokens"]}
    ranks = {b: i for b, i in ids.items() if i not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One per worker process."""
    return Vocabularies(a_path, b_path)


def groups_of(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered from 0, from the byte lengths of the tokens."""
    ends = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    starts = ends - np.concatenate([a_size, b_size])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_size)], group[len(a_size) :]


def links_of(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, times) of linked ids, sorted by key: key = base of the group + a * width + b.

    Groups of few links are written out link by link; in wider ones distinct ids are counted first.
    """
    n = len(base)
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE_GROUP
    times = np.where(wide[a_group], 0, n_b[a_group])
    left = np.repeat(np.arange(len(a)), times)
    within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    g = a_group[left]
    keys, counts = [base[g] + a[left] * width + b[first_b[g] + within]], [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(wide):
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        keys.append((base[g] + ids_a[:, None] * width + ids_b).ravel())
        counts.append((times_a[:, None] * times_b).ravel())
    return summed(np.concatenate(keys), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


class Aligned:
    """What is known of one text: token, group and link counts, the groups as text, and its linked pairs."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha = hashlib.sha256()
        self.pairs = self.times = np.zeros(0, np.int64)


def align_parts(parts: list[tuple[Aligned, np.ndarray, np.ndarray]], known: Vocabularies) -> None:
    """Align encoded parts of texts, all at once, and add what is found to their texts, in order."""
    a = np.concatenate([x for _, x, _ in parts]).astype(np.int64)
    b = np.concatenate([x for _, _, x in parts]).astype(np.int64)
    a_group, b_group = groups_of(known.a_size[a], known.b_size[b])
    # A part ends a token of both, so that no group reaches over it.
    a_part = np.repeat(np.arange(len(parts)), [len(x) for _, x, _ in parts])
    n_groups = int(a_group[-1]) + 1
    n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    group_part = a_part[np.cumsum(n_a) - n_a]
    width = len(known.b_bytes)
    per_part = len(known.a_bytes) * width
    keys, times = links_of(a, b, a_group, b_group, group_part * per_part, width)
    cut = np.searchsorted(keys, np.arange(len(parts) + 1) * per_part)
    # Tokens in the order of the text form: by group, those of A first; the separator says what comes next.
    group = np.concatenate([a_group, b_group])
    is_b = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((is_b, group))
    ids, group, is_b = np.concatenate([a, b])[order], group[order], is_b[order]
    after = np.where(group[1:] != group[:-1], 3, np.where(is_b[1:] != is_b[:-1], 2, 1))
    ends = np.cumsum([len(x) + len(y) for _, x, y in parts])
    after = np.append(after, 0)
    after[ends - 1] = 0
    written = known.written[ids * 4 + after].tolist()
    group_ends = np.searchsorted(group_part, np.arange(len(parts)), side="right")
    links = np.concatenate([[0], np.cumsum(n_a * n_b)])
    begin = group_begin = 0
    for i, (found, x, y) in enumerate(parts):
        if found.n_groups:
            found.sha.update(b";")
        found.sha.update("".join(written[begin : ends[i]]).encode())
        found.n_a += len(x)
        found.n_b += len(y)
        found.n_groups += int(group_ends[i] - group_begin)
        found.n_links += int(links[group_ends[i]] - links[group_begin])
        own, n = keys[cut[i] : cut[i + 1]] - i * per_part, times[cut[i] : cut[i + 1]]
        if len(found.pairs):
            own, n = summed(np.concatenate([found.pairs, own]), np.concatenate([found.times, n]))
        found.pairs, found.times = own, n
        begin, group_begin = ends[i], group_ends[i]


def align_texts(texts: Iterable[str], known: Vocabularies) -> list[Aligned]:
    """Align texts; one whose bytes the tokenizers do not keep has no tokens."""
    found, parts, chars = [], [], 0
    for text in texts:
        own = Aligned()
        found.append(own)
        if not text:
            continue
        encoded = [known.encode(part) for part in known.parts(text)]
        if any(both is None for both in encoded):
            continue
        for both in encoded[:-1]:
            align_parts([(own, *both)], known)
        parts.append((own, *encoded[-1]))
        chars += len(text)
        if chars >= BATCH_CHARS:
            align_parts(parts, known)
            parts, chars = [], 0
    if parts:
        align_parts(parts, known)
    return found


def aligned_rows(batches: Iterable[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    known = vocabularies(*paths)
    for batch in batches:
        at, size = 0, batch.num_rows
        while at < size:
            texts, chars, start = [], 0, at
            while at < size and chars <= BATCH_CHARS:
                texts.append(batch.column("text")[at].as_py() or "")
                chars += len(texts[-1])
                at += 1
            found = align_texts(texts, known)
            offsets = np.concatenate([[0], np.cumsum([len(f.pairs) for f in found])]).astype(np.int32)
            pairs, times = (
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in ([f.pairs for f in found], [f.times for f in found])
            )
            columns = [batch.column(c).slice(start, at - start) for c in ("row", "doc_id")]
            columns += [pa.array([getattr(f, c) for f in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array([f.sha.hexdigest() if f.n_groups else "" for f in found], pa.string()), pairs, times]
            yield pa.record_batch(columns, schema=ALIGNED)


def aligned(df: DataFrame, *, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    ``pairs`` has the distinct linked pairs of ids, each as a * (ids of B) + b, and ``times`` how many
    links of the text are of that pair. NULL and empty texts, and texts whose bytes are not kept by
    both tokenizers, have no tokens: zeros, empty lists and the empty text. Very long texts are aligned
    in parts that end between words. Repeated rows yield a row each; other columns are not read.
    """
    paths = paths or default_paths()
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")
    )
    return stored(rows.mapInArrow(lambda batches: aligned_rows(batches, paths), ALIGNED_SQL), "aligned")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, count (rows that hold it linked), best (no pair of the same A id has more); ties are all best."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pair-counts")
    a = F.expr(f"pair div {width}L")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    # One row per id of A at most.
    ranked = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return stored(ranked.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "ranked-pairs")


def with_hot_pairs(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with the sums over their frequent pairs, and their other pairs left in ``pairs`` and ``times``."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            offsets = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            keys, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            n_hit = np.where(hit, n, 0)
            total = np.concatenate([[0], np.cumsum(n_hit * count[at] if len(known) else n_hit)])
            bests = np.concatenate([[0], np.cumsum(np.where(best[at], n_hit, 0) if len(known) else n_hit)])
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32))
            more = [
                pa.array((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)),
                pa.array((bests[offsets[1:]] - bests[offsets[:-1]]).astype(np.int64)),
                pa.ListArray.from_arrays(left, pa.array(keys[~hit])),
                pa.ListArray.from_arrays(left, pa.array(n[~hit])),
            ]
            kept = [f for f in ALIGNED.names if f not in ("pairs", "times")]
            yield pa.record_batch([*[batch.column(c) for c in kept], *more], names=[*kept, "count_sum", "n_best", "pairs", "times"])

    schema = ALIGNED_SQL.replace("pairs array", "count_sum bigint, n_best bigint, pairs array")
    return rows.mapInArrow(run, schema)


def align(df: DataFrame, *, paths: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of every text with what the corpus says of its links.

    One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count
    of its A id, ties included), count_sum (counts summed over links), groups_sha256. See ``aligned`` for
    NULL, empty, long and repeated texts; an empty table has no rows here.

    Frequent pairs, at most ``hot_pairs``, reach the rows by broadcast, so that no pair that is left to
    the join has more than that part of all rows.
    """
    paths = paths or default_paths()
    width = len(vocabularies(*paths).b_bytes)
    rows = aligned(df, paths=paths, id_col=id_col, text_col=text_col)
    counts = pair_counts(rows, width)
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * hot_pairs > F.lit(total)
    hot = counts.where(frequent).orderBy("pair").collect()  # fewer than hot_pairs, as counts add up to total
    columns = [np.array([r[c] for r in hot], t) for c, t in (("pair", np.int64), ("count", np.int64), ("best", bool))]
    part = stored(with_hot_pairs(rows, tuple(columns)), "hot-pairs")
    rest = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    rest = rest.join(counts.where(~frequent), F.col("pairs") == F.col("pair"))
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    zero = F.lit(0).cast("bigint")
    return part.drop("pairs", "times").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
