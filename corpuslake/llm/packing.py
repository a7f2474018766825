"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of at most capacity/j and more than capacity/(j+1) tokens is of class j, and a bin
of class j takes just j pieces, whatever their lengths. As a document may be cut freely, its
tokens are cut to the classes: full sequences (class 1), a half (class 2), a quarter, an
eighth, which fill their bins without padding, and a rest of a class of its own. Each worker fills the bins
of its own partition in one pass, and at its end packs what the unfilled bins hold first
fit, longest first: fewer than 100 classes occur, so these are few, and no row is shuffled. A partition's rows are always read in
the same order, so a task that runs again gives the same sequences.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import text_batches

CAPACITY = 2048
END_ID = 1
#: The pre-tokeniser's pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A run of white space from this length on is left to tokenizers: tiktoken's pattern overflows its stack on 500,000.
LONG_SPACE = 10_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE vocabulary of a tokenizers file, run by tiktoken, three times as fast: the same ids for
    texts without an added token or a very long run of white space."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    octet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(octet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function that gives any text's ids as tokenizers does, the file's added tokens included.

    The texts that tiktoken cannot do go through tokenizers itself.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    exact = Tokenizer.from_file(path)
    fast = _encoder(path).encode_ordinary
    long_space = re.compile(r"\s{%d}" % LONG_SPACE)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or len(text) >= LONG_SPACE and long_space.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths into which n tokens are cut, in order."""
    found = [capacity] * (n // capacity)
    rest = n % capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if part and rest >= part:
            found.append(part)
            rest -= part
    return found + [rest] * (rest > 0)


class Packer:
    """Bins of one worker. A piece is (length, payload); closed bins are lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, length: int, payload) -> list | None:
        """Place a piece in its class's open bin; the bin, if that closes it."""
        j = self.capacity // length
        held = self.open.setdefault(j, [])
        held.append((length, payload))
        return self.open.pop(j) if len(held) == j else None

    def rest(self) -> list[list]:
        """What unfilled bins hold, packed first fit, longest first."""
        bins: list[list] = []
        room: list[int] = []
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[0]):
            i = next((i for i, r in enumerate(room) if r >= piece[0]), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(piece)
            room[i] -= piece[0]
        self.open = {}
        return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    A document's ids are those that the tokenizers file at tokenizer_path gives its whole text,
    without special tokens of the encoder's own, and end_id. A null or empty text has end_id
    alone. Repeated rows, and rows with a null doc_id, are packed each for itself; an empty table
    gives no rows; other columns than doc_id and text are not read. sequence_id is the partition's number times 2^32 plus a count.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(capacity)
        sequence = TaskContext.get().partitionId() << 32
        id_type = pa.int64()

        def rows(bins: list[list]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in names]
            for held in bins:
                offset = 0
                for length, (doc_id, start, ids, total) in held:
                    for column, value in zip(out, (doc_id, start, length, ids, total, sequence, offset)):
                        column.append(value)
                    offset += length
                sequence += 1
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        for b in batches:
            id_type = b.column("doc_id").type
            closed: list[list] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                start = 0
                for length in pieces(len(ids), capacity):
                    full = packer.add(length, (doc_id, start, ids[start : start + length].tobytes(), len(ids)))
                    if full is not None:
                        closed.append(full)
                    start += length
            if closed:
                yield rows(closed)
        if last := packer.rest():
            yield rows(last)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
