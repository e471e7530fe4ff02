"""Words of many texts at once: bytes are classed by a table, words numbered by Arrow, the rest is arrays.

All separators are ASCII, so UTF-8 texts are cut at bytes.  A text beyond the size of a group is
cut where the caller's units end, so what is held at a time is bounded by the longest unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z in lower case, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_set(members: Iterable[int]) -> np.ndarray:
    """A table of 256 booleans."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


@dataclass
class Words:
    """Words of some texts in order: ``word`` numbers ``names``; ``text`` is each word's text and ``piece`` its piece."""

    names: pa.Array
    word: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def hashes(self) -> np.ndarray:
        """An unsigned 64-bit hash of each name, never 0."""
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names.to_numpy(zero_copy_only=False)), np.uint64, len(self.names))
        found[found == 0] = 1
        return found


def words_of(texts: list[bytes], separators: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """The maximal runs of bytes outside ``separators``, A-Z in lower case; pieces end at ``breaks`` and with each text.

    Newline must be a separator, and a break if there are breaks.
    """
    data = np.frombuffer(b"".join(part for t in texts for part in (t, b"\n")).translate(LOWER), np.uint8)
    inside = ~separators[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    numbered = raw.dictionary_encode()
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(first, starts, "right") - 1
    piece = text if breaks is None else np.searchsorted(np.flatnonzero(breaks[data]), starts)
    return Words(numbered.dictionary, numbered.indices.to_numpy(), text, piece)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut(text: bytes, at: np.ndarray, size: int) -> Iterator[bytes]:
    """Parts of ``size`` bytes or a little more that end behind a byte of the set ``at``."""
    if len(text) <= size:
        yield text
        return
    ends = np.flatnonzero(at[np.frombuffer(text, np.uint8)]) + 1
    begin = 0
    while len(text) - begin > size:
        k = np.searchsorted(ends, begin + size)
        if k == len(ends):
            break
        yield text[begin : ends[k]]
        begin = int(ends[k])
    yield text[begin:]


def texts_of(batches: Iterable[pa.RecordBatch], at: np.ndarray, most_bytes: int, *names: str) -> Iterator[list[tuple]]:
    """Groups of rows (names..., text) with about ``most_bytes`` of texts; a long text comes as several rows, cut behind ``at``."""
    group: list[tuple] = []
    held = 0
    for batch in batches:
        columns = [batch.column(n) for n in names]
        texts = batch.column("text")
        for k in range(batch.num_rows):
            row = tuple(c[k].as_py() for c in columns)
            for part in cut(texts[k].as_py().encode(), at, most_bytes):
                group.append((*row, part))
                held += len(part)
                if held >= most_bytes:
                    yield group
                    group, held = [], 0
    if group:
        yield group
