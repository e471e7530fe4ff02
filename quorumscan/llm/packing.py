"""Packing of token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; the rests, longest
first, go to the open window that they leave the least room in.  A segment tree over
remaining capacities finds that window in O(log capacity).

Every task packs its own blocks of documents, so no text is shuffled and memory is bounded by
the block; a block of some thousands of documents already fills windows nearly to the brim.
The pieces of windows that are not, of small tasks above all, are packed once more: only their numbers
are shuffled, by a hash, to as many tasks as blocks of them need.  A sequence id is the task's number above
a count within it, and rows come to a task's packing in one order, so a task that runs again after a lost executor gives
the same rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import Out, held, pick, rows_of, written
from quorumscan.llm.tokenization import WordMemo, encoded_rows

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64()), ("fill", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, fill long"
#: Sequence ids of the second packing begin here, behind all task numbers of the first.
SECOND = 1 << 61


class CapacityTree:
    """Open windows by remaining capacity, with the least capacity of at least a need."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest open window with room for ``need``."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:  # up while a right child: what lies right of it is another's
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of the level
                return None
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """For each length (1 to capacity) its window and offset there; the fill of each window."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, fills = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room, window = tree.take(lengths[k]) or (capacity, len(fills))
        if window == len(fills):
            fills.append(0)
        placed[k] = (window, fills[window])
        fills[window] += lengths[k]
        if room > lengths[k]:
            tree.put(room - lengths[k], window)
    return placed, fills


def padded(fill: int, capacity: int) -> int:
    """A sequence is padded to the capacity unless its length is a power of two."""
    return fill if fill & (fill - 1) == 0 else capacity


def id_memo(path: str | None) -> WordMemo:
    """One memo per Python worker, as long as it packs: words to their ids as little-endian unsigned 32-bit numbers."""
    return held(("ids", path), lambda: WordMemo(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, block_pieces: int = 1 << 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document is its ids and ``end_id``; a null text is empty and so just ``end_id``.
    Pieces of a sequence lie gapless from offset 0.  Null or repeated identifiers are
    documents of their own; an empty table gives no rows; other columns are ignored.
    Ties in length go by the order of rows in the partition.  Texts of any length are packed whole.  ``block_pieces`` bounds the
    rests that are packed together.
    """

    def packed(out: Out, rests: list[tuple], next_id: int) -> int:
        """Add the rests (doc_id, start, length, crc, total) in windows numbered from ``next_id``; the next number."""
        placed, fills = best_fit_decreasing([r[2] for r in rests], capacity)
        for (doc_id, start, length, crc, total), (window, offset) in zip(rests, placed, strict=True):
            out.add(doc_id, start, length, crc, total, next_id + window, offset, padded(fills[window], capacity), fills[window])
        rests.clear()
        return next_id + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = id_memo(tokenizer)
        end, next_id = end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 36
        out, rests = Out(SCHEMA), []
        for batch in batches:
            for doc_id, ids in encoded_rows(batch, memo):
                data = ids + end
                total = len(data) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    out.add(doc_id, start, capacity, zlib.crc32(data[4 * start : 4 * (start + capacity)]), total, next_id, 0, capacity, capacity)
                    next_id += 1
                if full < total:
                    rests.append((doc_id, full, total - full, zlib.crc32(data[4 * full :]), total))
                if len(rests) >= block_pieces:
                    next_id = packed(out, rests, next_id)
                if out.full():
                    yield out.take()
        packed(out, rests, next_id)
        while len(out):
            yield out.take()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, out, rests = SECOND + (TaskContext.get().partitionId() << 36), Out(SCHEMA), []
        for batch in batches:
            for row in rows_of(batch, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"):
                rests.append(row[:-1])
                if len(rests) >= block_pieces:
                    next_id = packed(out, rests, next_id)
                if out.full():
                    yield out.take()
        packed(out, rests, next_id)
        while len(out):
            yield out.take()

    first = written(pick(docs, id_col, text_col).mapInArrow(run, DDL), "packed")
    loose = first.filter(F.col("fill") < F.lit(capacity - capacity // 32))
    n = loose.count()
    if n:
        piece = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        dealt = loose.select(*piece, F.lit("").alias("key")).repartition(-(-n // block_pieces), F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(*piece)
        first = first.filter(F.col("fill") >= F.lit(capacity - capacity // 32)).unionByName(dealt.mapInArrow(again, DDL))
    return first.drop("fill")
