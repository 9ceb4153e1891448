"""Encode by a minimal acyclic transducer of frequent words; decode.

Frequent chunks of the corpus are counted by Spark. Their ids are the outputs of an automaton that
shares prefixes and suffixes: each state knows how many words can be read from it, so reading a
word yields its number among the sorted words, and the number leads to its ids. The automaton is
one flat file that executors map into memory; a chunk that it does not hold is merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm import words
from roadgrain.llm.shared import SPACE_RUN, Rows, documents, stored, text_or_empty, text_rows

#: Words that the automaton holds at most: the bound of what goes to the driver and the executors.
LEXICON_WORDS = 60_000
#: Words seen less often are left to the merging.
LEAST_COUNT = 4
#: Longer chunks are no lexicon words.
LONGEST_WORD = 64
#: Pieces of more bytes are merged by a heap.
SHORT_PIECE = 48
#: Chunks whose ids a worker keeps.
KEPT = 1_000_000

MAGIC = b"MAT1"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_lexicon bigint"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("n_lexicon", pa.int64()),
    ]
)
#: Chunks of these characters are their own normal form but for case, and split by ``PIECE``.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9]|[^a-zß-öø-ÿªµº0-9]+")


class Merger:
    """Exact byte-pair merges of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the id that the merge of each rank makes
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.tokens |= {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.added = [t["content"] for t in whole["added_tokens"]]
        self.bytes = words.byte_letters()

    def word(self, piece: str) -> list[int]:
        """Ids of one piece: start from its bytes, merge the leftmost pair of lowest rank until none is left."""
        letters = [self.bytes[b] for b in piece.encode()]
        ids = [self.vocab[c] for c in letters[:-1]] + [self.vocab[letters[-1] + self.suffix]]
        return self._short(ids) if len(ids) <= SHORT_PIECE else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        """Ranks of all neighbours in a list; a merge changes two of them."""
        rank_of, none = self.merges.get, len(self.made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            ids[at : at + 2] = [self.made[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n steps."""
        rank_of, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, at) for at in range(n - 1) if (rank := rank_of((ids[at], ids[at + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            # Merged away or changed since it was put there.
            if ids[at] < 0 or right >= n or rank_of((ids[at], ids[right])) != rank:
                continue
            ids[at], ids[right] = self.made[rank], -1
            after[at] = follow = after[right]
            if follow < n:
                before[follow] = at
            for left, beside in ((before[at], at), (at, follow)):
                if left >= 0 and beside < n and (new := rank_of((ids[left], ids[beside]))) is not None:
                    heapq.heappush(heap, (new, left))
        return [i for i in ids if i >= 0]

    def plain_chunk(self, chunk: str) -> list[int]:
        return [i for piece in PIECE.findall(chunk.lower()) for i in self.word(piece)]


def compile_automaton(entries: list[tuple[bytes, bytes]]) -> bytes:
    """The flat file for (word, ids) entries: states with equal continuations are one state.

    Parts: head; first edge of each state; whether a word ends there; label, target and words
    skipped of each edge; where the ids of each word end; the ids.
    """
    entries = sorted({w: i for w, i in entries if w}.items())
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    sizes: list[int] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            sizes.append(final + sum(sizes[t] for _, t in edges))
        return known[key]

    open_: list[list] = [[False, []]]  # states along the last word that can still change
    last = b""

    def close_to(depth: int) -> None:
        while len(open_) > depth + 1:
            done = open_.pop()
            open_[-1][1].append((last[len(open_) - 1], settle(done[0], done[1])))

    for word, _ in entries:
        same = os.path.commonprefix([last, word])
        close_to(len(same))
        open_ += [[False, []] for _ in word[len(same) :]]
        open_[-1][0] = True
        last = word
    close_to(0)
    root = settle(*open_[0])

    first, labels, targets, skips = [0], [], [], []
    for final, edges in states:
        skipped = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(skipped)
            skipped += sizes[target]
        first.append(len(labels))
    ends = np.cumsum([len(ids) // 4 for _, ids in entries]) if entries else []
    parts = [
        np.array(first, "<u4"),
        np.array([f for f, _ in states], "<u1"),
        np.array(labels, "<u1"),
        np.array(targets, "<u4"),
        np.array(skips, "<u4"),
        np.array(ends, "<u4"),
        np.frombuffer(b"".join(ids for _, ids in entries), "<u4"),
    ]
    head = MAGIC + struct.pack("<I7Q", root, *(p.nbytes for p in parts))
    return head + b"".join(p.tobytes() for p in parts)


def plain_numbers(part: np.ndarray) -> memoryview | list[int]:
    """32-bit numbers whose items are plain ones, which those of an array are not; still in the mapped file."""
    return memoryview(part.view("u1")).cast("I") if sys.byteorder == "little" and len(part) else part.tolist()


class Automaton:
    """A compiled lexicon over any buffer, such as a memory-mapped file."""

    def __init__(self, buffer: memoryview) -> None:
        if bytes(buffer[:4]) != MAGIC:
            raise ValueError("not a lexicon file")
        self.root, *sizes = struct.unpack_from("<I7Q", buffer, 4)
        at, parts = 4 + struct.calcsize("<I7Q"), []
        for size, kind in zip(sizes, ("<u4", "<u1", "<u1", "<u4", "<u4", "<u4", "<u4"), strict=True):
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size
        first, self.final, labels, targets, skips, self.ends, self.ids = parts
        self.first, self.targets, self.skips = (plain_numbers(p) for p in (first, targets, skips))
        self.labels = labels.tobytes()  # few edges of a state are searched fastest as bytes

    def number(self, word: bytes) -> int:
        """The number of a word among the sorted words, or -1."""
        first, find, targets, skips = self.first, self.labels.find, self.targets, self.skips
        state, number = self.root, 0
        for byte in word:
            at = find(byte, first[state], first[state + 1])
            if at < 0:
                return -1
            number += skips[at]
            state = targets[at]
        return number if self.final[state] else -1

    def get(self, word: bytes) -> bytes | None:
        number = self.number(word)
        if number < 0:
            return None
        start = int(self.ends[number - 1]) if number else 0
        return self.ids[start : int(self.ends[number])].tobytes()


@lru_cache(maxsize=1)
def mapped(name: str) -> Automaton:
    """The lexicon file that Spark brought to this machine, mapped into memory."""
    with open(SparkFiles.get(name), "rb") as f:
        return Automaton(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


class Encoder(dict):
    """Chunk -> id bytes: the lexicon first, then exact merges; what is no plain text goes to the library."""

    def __init__(self, path: str, lexicon: Automaton, most: int = KEPT) -> None:
        super().__init__()
        self.merger, self.library = merger(path), words.chunk_ids(path).tokenizer
        self.lexicon, self.most = lexicon, most

    def __missing__(self, chunk: str) -> bytes:
        found = self.lexicon.get(chunk.encode("utf-8", "surrogatepass")) if len(chunk) <= LONGEST_WORD else None
        if found is None:
            found = self.unseen(chunk)
        if len(self) < self.most:
            self[chunk] = found
        return found

    def unseen(self, chunk: str) -> bytes:
        """Ids of a chunk that is no lexicon word; its word and its signs may be."""
        parts = words.word_and_signs(chunk)
        if parts and parts[1]:
            return self[parts[0]] + self[parts[1]]
        if parts and (lower := chunk.lower()) != chunk:
            return self[lower]
        if parts:
            return words.id_bytes(self.merger.word(chunk))
        if PLAIN.fullmatch(chunk) and not any(a in chunk for a in self.merger.added):
            return words.id_bytes(self.merger.plain_chunk(chunk))
        return words.id_bytes(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, words.chunks(text)))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.merger.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=1)
def encoder(path: str, name: str) -> Encoder:
    return Encoder(path, mapped(name))


def frequent_chunks(df: DataFrame, text_col: str, most: int, least: int) -> DataFrame:
    """The commonest chunks of all texts that come ``least`` times or more, ``most`` of them or somewhat fewer.

    How often a chunk must come is read from a histogram of the counts in steps of a sixteenth of a
    doubling, so that no task sends more than what is taken.
    """
    chunk = F.explode(F.split(text_or_empty(text_col), SPACE_RUN)).alias("chunk")
    counts = df.select(chunk).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    usable = (F.col("n") >= least) & (F.length("chunk").between(1, LONGEST_WORD)) & ~F.col("chunk").rlike(r"[\x1c-\x1f]")
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = stored(counts.filter(usable).withColumn("step", step), "chunk-counts")
    taken, lowest = 0, None
    for row in counts.groupBy("step").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("step")).collect():  # some hundred rows
        taken += row["chunks"]
        if taken > most:
            break
        lowest = row["step"]
    return counts.filter(F.col("step") >= F.lit(lowest)).select("chunk", "n")


def build_lexicon(df: DataFrame, *, text_col: str, path: str, most: int, least: int) -> bytes:
    """Count, encode and compile; at most ``most`` words reach the driver."""
    encode = words.chunk_ids(path)
    found = frequent_chunks(df, text_col, most, least).select("chunk").collect()
    return compile_automaton([(r.chunk.encode(), encode[r.chunk]) for r in found])


def share(spark: SparkSession, data: bytes) -> str:
    """Hand the file to all executors, later ones too, by Spark's own file server; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    local = os.path.join(outbox().name, name)
    with open(local, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(local)
    return name


@lru_cache(maxsize=1)
def outbox() -> tempfile.TemporaryDirectory:
    """The driver's folder that Spark's file server reads from, gone when the driver ends."""
    return tempfile.TemporaryDirectory(prefix="lexicon-")


def encode_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    lexicon_words: int = LEXICON_WORDS,
    least_count: int = LEAST_COUNT,
    keep_ids: bool = False,
) -> DataFrame:
    """Encode whole texts, decode the ids and return their digests.

    One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_lexicon (chunks of the
    text that the lexicon holds), and with ``keep_ids`` the ids and the decoded text. Null and empty
    texts have no ids and decode to the empty text; very long texts and words take time in proportion
    to their length, but for a logarithm; repeated rows yield a row each; an empty table yields none; other columns are not read.
    """
    path = tokenizer_path or words.default_path()
    spark = df.sparkSession
    name = share(spark, build_lexicon(df, text_col=text_col, path=path, most=lexicon_words, least=least_count))
    schema, arrow = SCHEMA, ARROW
    if keep_ids:
        schema += ", ids array<bigint>, decoded string"
        arrow = pa.schema([*ARROW, ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = encoder(path, name), Rows(arrow)
        for doc_id, text in text_rows(batches, "doc_id", "text"):
            data = own.encode(text)
            ids = np.frombuffer(data, "<u4")
            decoded = own.decode(ids)
            row = [doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), 0]
            if keep_ids:
                row[4] = sum(own.lexicon.number(c.encode()) >= 0 for c in words.chunks(text))
                row += [ids.tolist(), decoded]
            if rows.add(*row, size=len(data) * 4 if keep_ids else 0):
                yield rows.take()
        yield rows.take()

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def op4_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir)).drop("n_lexicon")
