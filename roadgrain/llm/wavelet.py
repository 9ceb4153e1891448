"""Token shards as wavelet matrices.

A shard holds the ids of consecutive documents as bit planes, the highest bit first; each plane
keeps the tokens in the order of a stable split by the bits above it. The file stores the count of
ones up to each block and word beside each plane, so that it answers access, count and the place of
the k-th occurrence in one step per plane. Whole shards are read by undoing the splits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm import words
from roadgrain.llm.shared import Rows, documents, scratch_path, text_rows

MAGIC = b"WVMR"
#: Bits per block of the rank directory, and per word.
BLOCK, WORD = 512, 64
#: Parts of a shard file before its planes.
PARTS_BEFORE = 4
#: Places that are looked up at once.
READ_TOKENS = 1 << 16
#: Tokens after which a task closes a shard.
SHARD_TOKENS = 2_000_000
END_ID = 1

SHARDS = (
    "part int, shard int, part_start bigint, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint, payload binary"
)
ARROW_SHARDS = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("part_start", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("payload", pa.binary()),
    ]
)
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, shard int"
ARROW_READ = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + [("part", pa.int32()), ("shard", pa.int32())]
)


class OnDemand(Sequence):
    """A list whose items are made when they are first asked for."""

    def __init__(self, make: Callable[[int], object], n: int) -> None:
        self.make, self.n = cache(make), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> object:
        return self.make(range(self.n)[i])


class WaveletMatrix:
    """Bit planes over a sequence of unsigned ids, as 64-bit words.

    ``ranks`` holds two tables for each plane: the ones before each block, and before each word of it.
    """

    def __init__(self, n: int, planes: Sequence, zeros: list[int], ranks: Sequence) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.upto = OnDemand(self._before_words, len(planes))

    def _before_words(self, level: int) -> np.ndarray:
        """Ones before each word of a plane: its two tables of ranks added up."""
        blocks, inner = self.ranks[level]
        return blocks.astype(np.int64).repeat(BLOCK // WORD) + inner

    @staticmethod
    def _plane(ones: np.ndarray) -> np.ndarray:
        """The bits as words; whole blocks, with a place after the last bit."""
        bits = np.zeros((len(ones) // BLOCK + 1) * BLOCK, bool)
        bits[: len(ones)] = ones
        return np.packbits(bits, bitorder="little").view("<u8")

    @staticmethod
    def _directory(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each block, and in each block before each of its words."""
        held = np.bitwise_count(plane).astype(np.int64).reshape(-1, BLOCK // WORD)
        upto = held.cumsum(axis=1)
        blocks = np.concatenate(([0], upto[:-1, -1].cumsum()))
        return blocks.astype("<u4"), (upto - held).ravel().astype("<u2")

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        order = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            ones = (order & order.dtype.type(1 << k)) != 0
            planes.append(cls._plane(ones))
            low = order[~ones]
            zeros.append(len(low))
            order = np.concatenate((low, order[ones]))
        return cls(len(ids), planes, zeros, [cls._directory(p) for p in planes])

    def look_up(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit of a plane at each place, and the ones before it: a word and the ranks beside it."""
        word, bit = at >> 6, (at & 63).view(np.uint64)
        bits = self.planes[level][word]
        below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
        return (bits >> bit & np.uint64(1)).view(np.int64), self.upto[level][word] + below

    def ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        return self.look_up(level, at)[1]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64)
        found = np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit, ones = self.look_up(level, at)
            found = found << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return found.astype(np.uint32)

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, by access to so many places at a time."""
        steps = range(start, end, READ_TOKENS)
        return np.concatenate([np.empty(0, np.uint32), *(self.access(np.arange(a, min(a + READ_TOKENS, end))) for a in steps)])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            lo, hi = self.ones_before(level, np.array([start, end], np.int64)).tolist()
            if (token >> (len(self.planes) - 1 - level)) & 1:
                start, end = self.zeros[level] + lo, self.zeros[level] + hi
            else:
                start, end = start - lo, end - hi
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token from ``start`` up to ``end``."""
        if not self.n or token >> len(self.planes):
            return 0
        lo, hi = self._range(token, start, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0; -1 if there is none."""
        if not self.n or token >> len(self.planes):
            return -1
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = (token >> (len(self.planes) - 1 - level)) & 1
            at = self._place(level, at - self.zeros[level] if one else at, one)
        return at

    def _place(self, level: int, k: int, one: int) -> int:
        """The place of the k-th bit of a kind in a plane."""
        ranks = self.ranks[level][0].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        words_ = self.planes[level][block * (BLOCK // WORD) : (block + 1) * (BLOCK // WORD)]
        bits = np.unpackbits(words_.view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token."""
        return np.array([self.select(token, k) for k in range(self.count(token))], np.int64)

    def ids(self) -> np.ndarray:
        """All ids in order: the splits undone from the lowest plane up."""
        wide = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, wide)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(values), self.zeros[level]
            above[~ones] = values[:zeros]
            above[ones] = values[zeros:] | wide(1 << (len(self.planes) - 1 - level))
            values = above
        return values.astype(np.uint32)


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard file: head, documents (id, null mark, length), zeros per plane, then each plane and its two
    tables of ranks; each part is compressed by itself."""
    matrix, press = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.array(lengths, "<i8"),
        np.array(matrix.zeros, "<i8"),
    ]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [plane, *ranks]
    pressed = [press(p.tobytes()) for p in parts]
    head = MAGIC + struct.pack("<QQI", len(ids), len(doc_ids), len(pressed))
    return head + struct.pack(f"<{len(pressed)}Q", *map(len, pressed)) + b"".join(pressed)


def shard_parts(payload: bytes) -> tuple[int, int, Callable[[int, str], np.ndarray]]:
    """Tokens, planes, and how to open a part of the file as numbers of a kind."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token shard")
    n, _, count = struct.unpack_from("<QQI", payload, 4)
    sizes = struct.unpack_from(f"<{count}Q", payload, 24)
    ends = np.cumsum([24 + 8 * count, *sizes]).tolist()

    def part(i: int, kind: str) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[ends[i] : ends[i + 1]]), kind)

    return n, (count - PARTS_BEFORE) // 3, part


def open_matrix(payload: bytes) -> WaveletMatrix:
    """The matrix of a shard file; a plane and its ranks are unpacked when they are first needed."""
    n, planes, part = shard_parts(payload)
    first = range(PARTS_BEFORE, PARTS_BEFORE + 3 * planes, 3)
    ranks = OnDemand(lambda k: (part(first[k] + 1, "<u4"), part(first[k] + 2, "<u2")), planes)
    return WaveletMatrix(n, OnDemand(lambda k: part(first[k], "<u8"), planes), part(3, "<i8").tolist(), ranks)


def shard_documents(payload: bytes) -> tuple[list[int | None], list[int]]:
    """Document ids and lengths of a shard file; no plane is read."""
    part = shard_parts(payload)[2]
    doc_ids = [None if null else d for d, null in zip(part(0, "<i8").tolist(), part(1, "u1").tolist(), strict=True)]
    return doc_ids, part(2, "<i8").tolist()


def write_shards(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode whole texts in ascending id order and write one row per shard to a Parquet folder.

    Documents are dealt by ranges of the id; each task writes shards of about ``shard_tokens`` ids
    (a longer document makes a longer shard) and a document never spans two. Null and empty texts
    are the end id alone; null ids come first; equal ids stand next to each other in the order of
    their text's hash. Other columns are not read.
    """
    path_, end = tokenizer_path or words.default_path(), np.uint32(end_id).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = words.chunk_ids(path_).encode, TaskContext.get().partitionId()
        docs, lengths, pieces = [], [], []
        shard = start = held = 0

        def close() -> pa.RecordBatch:
            rows = Rows(ARROW_SHARDS)
            payload = write_shard(docs, lengths, np.frombuffer(b"".join(pieces), "<u4"))
            rows.add(part, shard, start, len(docs), held, docs[0], docs[-1], payload)
            return rows.take()

        for doc_id, text in text_rows(batches, "doc_id", "text"):
            ids = encode(text) + end
            docs.append(doc_id)
            lengths.append(len(ids) // 4)
            pieces.append(ids)
            held += lengths[-1]
            if held >= shard_tokens:
                yield close()
                docs, lengths, pieces = [], [], []
                shard, start, held = shard + 1, start + held, 0
        if docs:
            yield close()

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    ranged = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def part_starts(shards: DataFrame) -> DataFrame:
    """Tokens before each part: a running sum over one row per writing task."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document from the shard files: doc_id, start, n_tokens, ids_crc32, part, shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(ARROW_READ, most=20_000)
        for batch in batches:
            for part, shard, start, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matrix, at = open_matrix(payload), 0
                ids = matrix.ids()
                for doc_id, n in zip(*shard_documents(payload), strict=True):
                    if rows.add(doc_id, start + at, n, zlib.crc32(ids[at : at + n]), part, shard):
                        yield rows.take()
                    at += n
        yield rows.take()

    local = shards.select("part", "shard", "part_start", "payload").mapInArrow(run, READ)
    starts = part_starts(shards)
    return local.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )


def count_tokens(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of a token per shard, counted on the bit planes: part, shard, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            rows = Rows(schema)
            for part, shard, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.add(part, shard, open_matrix(payload).count(token))
            yield rows.take()

    return shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, n bigint")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write_shards(documents(spark, sf_dir), path)
    return read_documents(spark.read.schema(SHARDS).parquet(path))
