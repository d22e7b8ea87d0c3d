"""Harmonic packing of documents into training sequences.

Documents, ended by the end id, stay whole where they can. Class k holds the lengths in (capacity / (k + 1),
capacity / k], and a bin of class k takes k documents of it, so no bin needs to look at another. A longer document is
cut into whole sequences, and what is left of it fills the room that bins have beside their documents, in as many
pieces as it takes; what isn't needed for that joins its class. Bins with room wait for such pieces, WAITING of them at
most: if no long documents come, the next document is cut in their place, so padding stays small on any lengths.

Each worker fills its own bins. At its end the documents that wait in classes go, longest first, where they fit, and if
the bins' rooms add up to a sequence, the roomiest is cut up for the others: less than one sequence of padding is left
per worker, but for rooms below SMALLEST.

Ids come from the byte-level BPE vocabulary. tiktoken encodes with it several times faster than tokenizers and with
the same ids; a text with characters beyond Latin, or with a very long run without a space, goes to tokenizers itself.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

#: Room below SMALLEST ids is left as padding.
CAPACITY, SMALLEST, END = 1024, 32, 0
#: Bins with room that wait for pieces, and rests of long documents that wait for room, in a worker.
WAITING, SPARE = 64, 64
_BEYOND = re.compile("[^\x00-ɏ]|[^\x20\x09-\x0d]{2000}")
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> its ids (numpy), as Tokenizer.from_file(json_path).encode(text, add_special_tokens=False) has them."""
    import tiktoken
    from tokenizers import Tokenizer

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: _SPECIAL_ID})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if _BEYOND.search(text):
            if not slow:
                slow.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode(text, allowed_special="all") if _SPECIAL in text else fast.encode_ordinary(text), "<u4")

    return encode


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths, in order, of the whole sequences of a document of n ids, and of what is left."""
    return [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)


class Bins:
    """One worker's open bins. put() and close() yield (piece, sequence, offset); a piece is (document, start, ids, document's length)."""

    def __init__(self, capacity: int = CAPACITY, smallest: int = SMALLEST) -> None:
        self.capacity, self.smallest, self.n = capacity, smallest, 0
        self.open: dict[int, list[tuple]] = {}  # by class
        self.room: list[tuple[list[tuple], int]] = []  # bins that have their documents, and the room they have left
        self.rests: list[tuple] = []

    def _full(self, held: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in held:
            yield piece, self.n, at
            at += len(piece[2])
        self.n += 1

    def put(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        n, start = len(ids), 0
        for length in pieces(n, self.capacity):
            piece = doc, start, ids[start : start + length], n
            start += length
            if length == self.capacity:
                yield from self._full([piece])
            elif n > self.capacity or len(self.room) >= WAITING:
                self.rests.append(piece)
                yield from self._fill()
                if len(self.rests) > SPARE:
                    yield from self._classed(self.rests.pop(0))
            else:
                yield from self._classed(piece)

    def _classed(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self._roomy(held)

    def _roomy(self, held: list[tuple]) -> Iterator[tuple]:
        """A bin that has its documents: done, or waiting for what fills it."""
        room = self.capacity - sum(len(p[2]) for p in held)
        if room < self.smallest:
            yield from self._full(held)
        else:
            self.room.append((held, room))
            yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        while self.room and self.rests:
            (held, room), (doc, start, ids, n) = self.room.pop(0), self.rests.pop(0)
            held.append((doc, start, ids[:room], n))
            if len(ids) > room:
                self.rests.insert(0, (doc, start + room, ids[room:], n))
            if room - len(ids) >= self.smallest:
                self.room.insert(0, (held, room - len(ids)))
            else:
                yield from self._full(held)

    def close(self) -> Iterator[tuple]:
        bins = [*self.room]
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2])):
            at = min((i for i, (_, room) in enumerate(bins) if room >= len(piece[2])), key=lambda i: bins[i][1], default=None)
            if at is None:
                at = len(bins)
                bins.append(([], self.capacity))
            bins[at] = [*bins[at][0], piece], bins[at][1] - len(piece[2])
        self.room = sorted((b for b in bins if b[1] >= self.smallest), key=lambda b: b[1])
        for held, room in bins:
            if room < self.smallest:
                yield from self._full(held)
        yield from self._fill()
        while self.rests or sum(room for _, room in self.room) >= self.capacity:
            if self.rests:  # no bin has room left
                self.room = [([], self.capacity)]
            else:  # the others have room for what the roomiest bin holds
                self.rests = self.room.pop()[0]
            yield from self._fill()
        for held, _ in self.room:
            yield from self._full(held)
        self.open, self.room = {}, []


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, smallest: int = SMALLEST, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A null text counts as empty: one piece with the end id. Repeated rows are packed again. Other columns of df are not
    used. A document of up to `capacity` ids is cut only if no long ones fill the room beside others. Sequence ids are unique over workers: partition * 2 ** 33 + number. An empty table gives no rows.
    """
    if capacity & (capacity - 1) or smallest & (smallest - 1) or not 0 < smallest <= capacity:
        raise ValueError("capacity and smallest must be powers of two")
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, part, kind = encoder(), Bins(capacity, smallest), 0, None

        def table(placed: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*[(start, len(ids), zlib.crc32(ids.tobytes()), n, (part << 33) + s, o) for (_, start, ids, n), s, o in placed], strict=True)) or [()] * 6
            arrays = [pa.array([p[0] for p, _, _ in placed], kind), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            if with_ids:
                arrays.append(pa.array([p[2].astype(np.int32) for p, _, _ in placed], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")], *["ids"] * with_ids])

        for b in batches:
            placed, kind = [], b.schema.field(0).type
            if b.num_rows:
                part = b.column(2)[0].as_py()
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                placed += bins.put(d, np.append(encode(t), np.uint32(END)).astype("<u4"))
            yield table(placed)
        if kind is not None:
            yield table(list(bins.close()))

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}" + ", ids array<int>" * with_ids)
