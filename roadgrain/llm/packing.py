"""Hierarchical multi-length packing of token sequences.

Each task encodes and packs the documents it reads; no token leaves its task, and a task holds one
block of documents at a time. A document longer than the longest window fills whole windows; what
is left is routed to the tier of the smallest window that holds it. Tiers are packed from the long
one to the short one, best fit first. A gap in a long window takes the longest waiting document of
a shorter tier that fits, and at last a piece cut from the next one, so every window is full. What
cannot fill a window waits for the next block, and at the end of the task it is cut into sequences
of power-of-two length. No sequence needs padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from roadgrain.llm import words
from roadgrain.llm.shared import Rows, documents, text_rows

TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task holds before it packs them.
BLOCK_TOKENS = 2_000_000
#: Sequences of one tier that make a step.
STEP = 8
END_ID = 2
#: Bits of a sequence id below the task's number.
TASK_BITS = 36

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, `offset` bigint, tier bigint, step_id bigint"
)
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")]
)


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of one document."""

    doc: int
    start: int
    length: int


@dataclass
class Window:
    size: int
    pieces: list[Piece] = field(default_factory=list)
    free: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.free -= piece.length


class Waiting:
    """Pieces of one tier, sorted by length."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.by_length: dict[int, list[Piece]] = {}
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        insort(self.lengths, piece.length)
        self.by_length.setdefault(piece.length, []).append(piece)
        self.tokens += piece.length

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` tokens."""
        at = bisect_right(self.lengths, most) - 1
        return self._pop(at) if at >= 0 else None

    def take_shortest(self) -> Piece | None:
        return self._pop(0) if self.lengths else None

    def _pop(self, at: int) -> Piece:
        piece = self.by_length[self.lengths.pop(at)].pop()
        self.tokens -= piece.length
        return piece


class Packer:
    """Pieces in, full windows out; what cannot fill a window stays."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.waiting = {size: Waiting() for size in self.tiers}

    def route(self, piece: Piece) -> None:
        self.waiting[next(size for size in self.tiers if piece.length <= size)].add(piece)

    def add(self, doc: int, tokens: int) -> list[Window]:
        """Route a document; its whole windows come back at once."""
        longest, full = self.tiers[-1], []
        whole = tokens // longest
        for k in range(whole):
            full.append(Window(longest, [Piece(doc, k * longest, longest)]))
        if rest := tokens - whole * longest:
            self.route(Piece(doc, whole * longest, rest))
        return full

    def pack(self) -> list[Window]:
        """Full windows of every tier, the longest first."""
        full = []
        for at in range(len(self.tiers) - 1, -1, -1):
            size, usable = self.tiers[at], self.tiers[: at + 1]
            while self.waiting[size].lengths and sum(self.waiting[t].tokens for t in usable) >= size:
                full.append(self._fill(size, usable))
        return full

    def _fill(self, size: int, usable: tuple[int, ...]) -> Window:
        window = Window(size, free=size)
        while window.free:
            piece = next((p for t in reversed(usable) if (p := self.waiting[t].take(window.free))), None)
            if piece is None:  # nothing fits whole: cut the shortest one
                piece = next(p for t in usable if (p := self.waiting[t].take_shortest()))
                self.route(Piece(piece.doc, piece.start + window.free, piece.length - window.free))
                piece = Piece(piece.doc, piece.start, window.free)
            window.add(piece)
        return window

    def finish(self) -> list[Window]:
        """The rest as sequences of power-of-two length, so that none is padded."""
        full = self.pack()
        left: list[Piece] = []
        for size in reversed(self.tiers):
            while piece := self.waiting[size].take(size):
                left.append(piece)
        left.reverse()
        tokens = sum(p.length for p in left)
        while tokens:
            size = min(self.tiers[-1], 1 << (tokens.bit_length() - 1))
            window = Window(size, free=size)
            while window.free:
                piece = left.pop()
                if piece.length > window.free:
                    left.append(Piece(piece.doc, piece.start + window.free, piece.length - window.free))
                    piece = Piece(piece.doc, piece.start, window.free)
                window.add(piece)
            full.append(window)
            tokens -= size
        return full


def balanced_steps(windows: list[Window], step: int = STEP) -> list[int]:
    """A step number for each window: windows of one size, dealt so that attention costs are even.

    The cost of a window is the sum of its squared piece lengths. Windows are dealt to the steps of
    their size in order of cost, forth and back.
    """
    found, first = [0] * len(windows), 0
    for size in sorted({w.size for w in windows}):
        own = [i for i, w in enumerate(windows) if w.size == size]
        own.sort(key=lambda i: -sum(p.length**2 for p in windows[i].pieces))
        steps = -(-len(own) // step)
        for rank, i in enumerate(own):
            lap, at = divmod(rank, steps)
            found[i] = first + (at if lap % 2 == 0 else steps - 1 - at)
        first += steps
    return found


def pack_partition(
    rows: Iterable[tuple[object, bytes]], task: int, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS
) -> Iterator[pa.RecordBatch]:
    """Pack (doc_id, id bytes) rows; yields batches of pieces."""
    packer, out = Packer(tiers), Rows(ARROW, most=20_000)
    texts: dict[int, list] = {}  # doc number -> [doc_id, id bytes, tokens not yet placed]
    base, sequence, step_base, held = task << TASK_BITS, 0, 0, 0
    ready: list[Window] = []

    def place(windows: list[Window]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence, step_base
        steps = balanced_steps(windows)
        for window, step in zip(windows, steps, strict=True):
            offset = 0
            for p in window.pieces:
                doc = texts[p.doc]
                crc = zlib.crc32(memoryview(doc[1])[4 * p.start : 4 * (p.start + p.length)])
                full = out.add(
                    doc[0], p.start, p.length, crc, len(doc[1]) // 4, base + sequence, offset, window.size, base + step_base + step
                )
                offset += p.length
                doc[2] -= p.length
                if not doc[2]:
                    del texts[p.doc]
                if full:
                    yield out.take()
            sequence += 1
        step_base += max(steps, default=-1) + 1

    for number, (doc_id, ids) in enumerate(rows):
        n = len(ids) // 4
        texts[number] = [doc_id, ids, n]
        ready += packer.add(number, n)
        held += n
        if held >= block_tokens:
            yield from place(ready + packer.pack())
            ready, held = [], 0
    yield from place(ready + packer.finish())
    yield out.take()


def pack_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pack whole texts, each followed by ``end_id``, into sequences of at most the longest tier.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the
    sequence's length) and step_id. Null and empty texts are the end id alone; a null id stays null;
    rows with equal ids are packed each for itself; other columns are not read. An empty table gives
    no rows. Tiers must be powers of two.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path, end = tokenizer_path or words.default_path(), np.uint32(end_id).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], bytes] = words.chunk_ids(path).encode
        rows = ((k, encode(t) + end) for k, t in text_rows(batches, "doc_id", "text"))
        yield from pack_partition(rows, TaskContext.get().partitionId(), tiers, block_tokens)

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
