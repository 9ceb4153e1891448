"""Token ids of whole texts by a BPE vocabulary that never merges across white space.

A chunk between white space is encoded once by the tokenizers library and kept, so a text is one
dictionary look-up per chunk. This is exact: normalising, splitting and merging of that vocabulary
are all local to a chunk. U+001C to U+001F are white space for ``str.split`` but not for the
vocabulary; texts that hold one are split by the vocabulary's own rule.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Chunks kept per worker; further chunks are encoded each time they come.
KEPT_CHUNKS = 1_200_000
#: Separators that only ``str.split`` takes for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
ASCII_CHUNK = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: Words whose normal form is their lower case and which are one piece.
PLAIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    """Pieces of a text between white space."""
    if any(c in text for c in SEPARATORS):
        return ASCII_CHUNK.findall(text)
    return text.split()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def word_and_signs(chunk: str) -> tuple[str, str] | None:
    """A plain word and the ASCII signs after it, which the vocabulary takes as two pieces; None for other chunks."""
    word = chunk.rstrip(string.punctuation)
    return (word, chunk[len(word) :]) if PLAIN_WORD.fullmatch(word) else None


class ChunkIds(dict):
    """Little-endian 32-bit ids of a chunk as bytes, worked out when first asked for.

    A plain word is lower-cased and merged by the library's model; the signs after it and all other
    chunks go through the library's whole encoder.
    """

    def __init__(self, path: str, most: int = KEPT_CHUNKS) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        parts = word_and_signs(chunk)
        if parts is None:
            found = id_bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        elif parts[1]:
            found = self[parts[0]] + self[parts[1]]
        elif (lower := chunk.lower()) != chunk:
            found = self[lower]
        else:
            found = self.merged(chunk)
        if len(self) < self.most:
            self[chunk] = found
        return found

    def merged(self, word: str) -> bytes:
        """Ids of a plain lower-case word."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return id_bytes([t.id for t in self.model.tokenize(word)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, chunks(text)))


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if found.itemsize != 4:
        found = array("L", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One cache per worker process and vocabulary file."""
    return ChunkIds(path)
