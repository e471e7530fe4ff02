"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts texts into chunks at places that depend on
the content alone, so passages that documents share give the same chunks whatever
stands before them.  A chunk is encoded once and remembered: the ids of its inner part,
from its first to its last white space, and the raw fragments before and after.

A chunk may begin or end inside a word.  Joins are repaired by re-encoding: the
fragments that meet are put together, and more chunks are taken in, until the
re-encoded part has white space at both ends; from there on the ids agree exactly
with an encoding of the whole text, since nothing in the tokenizer reaches across
white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorumscan.llm.common import Out, groups_of, pick
from quorumscan.llm.tokenization import PROBES, WordMemo

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Bytes that the rolling hash looks at, and one boundary in so many bytes on average.
WINDOW, MEAN_CHUNK = 8, 128
SPACES = b" \t\n\x0b\x0c\r"


def boundaries(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Ends of the chunks of ``data``: where the hash of the last ``WINDOW`` bytes is 0 modulo ``mean``, and the end."""
    ends: list[int] = []
    step = 1 << 20
    for begin in range(0, len(data), step):
        part = np.frombuffer(data, np.uint8, count=min(step + WINDOW - 1, len(data) - begin), offset=begin).astype(np.uint32)
        if len(part) < WINDOW:
            break
        n = len(part) - WINDOW + 1
        h = np.zeros(n, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(2654435761)
            h += part[k : k + n]
        h ^= h >> np.uint32(15)
        ends += (np.flatnonzero(h % np.uint32(mean) == 0) + (begin + WINDOW)).tolist()
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    return ends


class Values:
    """What a run of ids comes to: their number, their decimals and their tokens, each joined by a space."""

    def __init__(self, path: str | None) -> None:
        self.words = WordMemo(path, self.of, keep=200_000)
        tokenizer = self.words.tokenizer
        for probe in PROBES:
            e = tokenizer.encode(probe, add_special_tokens=False)
            if tokenizer.decode(e.ids, skip_special_tokens=False) != " ".join(e.tokens):
                raise ValueError("the tokenizer does not decode to its tokens joined by spaces")

    def of(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        token = self.words.tokenizer.id_to_token
        return len(ids), b" ".join(b"%d" % i for i in ids), " ".join(map(token, ids)).encode()

    def encode(self, data: bytes) -> tuple[int, bytes, bytes]:
        return merged(self.words.values(data))


def merged(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    parts = [p for p in parts if p[0]]
    return sum(p[0] for p in parts), b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts])


class ChunkEncoder:
    """Encodes texts by chunks; ``keep_bytes`` bounds the remembered chunks, beyond it they start anew."""

    def __init__(self, path: str | None = None, mean: int = MEAN_CHUNK, keep_bytes: int = 48 << 20) -> None:
        self.values, self.mean, self.keep_bytes = Values(path), mean, keep_bytes
        self.chunks: dict[bytes, tuple] = {}
        self.held = self.encoded = self.reused = 0

    @staticmethod
    def fragments(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """(head, inner part, tail); the inner part is None where the chunk has no white space and is all head."""
        words = chunk.split()
        if words[:1] == [chunk]:
            return chunk, None, b""
        head = b"" if chunk[0] in SPACES or not words else words[0]
        tail = b"" if chunk[-1] in SPACES or not words else words[-1]
        return head, chunk[len(head) : len(chunk) - len(tail)], tail

    def _remember(self, chunks: set[bytes]) -> None:
        """Encode the chunks not seen before, their words in one batch."""
        new = [c for c in chunks if c not in self.chunks]
        self.encoded += len(new)
        self.held += sum(3 * len(c) + 400 for c in new)
        if self.held > self.keep_bytes:
            self.chunks.clear()
            new = list(chunks)
            self.held = sum(3 * len(c) + 400 for c in new)
        cut = [(c, *self.fragments(c)) for c in new]
        self.values.words.learn({w for _, _, inner, _ in cut if inner for w in inner.split()})
        for chunk, head, inner, tail in cut:
            self.chunks[chunk] = head, None if inner is None else self.values.encode(inner), tail

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of ids, their decimals joined by a space, the decoded text."""
        cut = []
        for data in texts:
            ends = boundaries(data, self.mean)
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        distinct = {c for pieces in cut for c in pieces}
        self._remember(distinct)
        self.reused += sum(map(len, cut)) - len(distinct)
        plans = [self._joined(pieces) for pieces in cut]
        self.values.words.learn({j for plan in plans for j in plan if type(j) is bytes})
        for plan in plans:
            yield merged([self.values.encode(x) if type(x) is bytes else x for x in plan])

    def _joined(self, pieces: list[bytes]) -> list:
        """Inner values in order, and between them the joins that are to be re-encoded."""
        plan: list = []
        joins: list[bytes] = []
        for piece in pieces:
            head, inner, tail = self.chunks[piece]
            joins.append(head)
            if inner is None:
                continue  # no white space yet: the join takes in one more chunk
            if joined := b"".join(joins):
                plan.append(joined)
            plan.append(inner)
            joins = [tail]
        if joined := b"".join(joins):
            plan.append(joined)
        return plan


@cache
def worker_encoder(path: str | None, mean: int) -> ChunkEncoder:
    """One encoder per Python worker, so that chunks are shared by all its tasks."""
    return ChunkEncoder(path, mean)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty: 0 tokens, digests of the empty string.  Null or repeated
    identifiers pass through; an empty table gives no rows; other columns are ignored.
    Texts of any length are encoded whole, in bounded pieces.  A tokenizer that does not encode words between
    white space by themselves, or does not decode to its tokens joined by spaces, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = worker_encoder(tokenizer, mean_chunk), Out(SCHEMA)
        for batch in batches:
            for rows in groups_of(batch, "doc_id", "text"):
                for (doc_id, _), (n, ids, decoded) in zip(rows, encoder.encode_all([encoder.values.words.folded(t.encode()) for _, t in rows]), strict=True):
                    out.add(doc_id, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
            if len(out):
                yield out.take()

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
