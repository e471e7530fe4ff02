"""Token counts of whole texts for a ``sentencepiece`` model, lengths only.

Texts are cut at safe boundaries, batches of about equal bytes are encoded, and only
lengths leave the Arrow function.  A boundary is safe at a space between two letters or
digits that normalisation leaves alone: what stands there is one space mark, the end of no piece
and the start of at most one, where no piece of the vocabulary has the space mark behind any
other character and spaces are kept as they are.  (Other
vocabularies are encoded uncut.)  The library puts a space
mark before what it encodes; the boundary's own space is therefore left to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quorumscan.llm.common import Out, pick, rows_of

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
#: Where a text may be cut: a space between word characters.
BETWEEN = re.compile(r"(?<=\w) (?=\w)")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def plain(c: str) -> bool:
    """Whether a character is a letter or digit that stays as it is beside any other."""
    return c.isalnum() and (c.isascii() or unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c))


class PieceCounter:
    """Counts tokens of texts; ``batch_bytes`` bounds what the library gets at once, ``part_chars`` a part of a text."""

    def __init__(self, model_path: str | None = None, batch_bytes: int = 1 << 20, part_chars: int = 1 << 14) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path(PIECE_BPE))
        self.batch_bytes, self.part_chars = batch_bytes, part_chars
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        marks = self.model.encode("a  a") != self.model.encode("a a") and self.model.encode(" a") != self.model.encode("a")
        self.safe = marks and all(MARK not in p.lstrip(MARK) for p in pieces)

    def parts(self, text: str) -> Iterator[str]:
        """The text cut at safe boundaries, without the space of each boundary."""
        begin = 0
        while self.safe and len(text) - begin > self.part_chars:
            found = BETWEEN.finditer(text, begin + self.part_chars)
            at = next((m.start() for m in found if plain(text[m.start() - 1]) and plain(text[m.end()])), None)
            if at is None:
                break
            yield text[begin:at]
            begin = at + 1
        yield text[begin:]

    def counts(self, texts: Iterable[str]) -> list[int]:
        totals: list[int] = []
        owners: list[int] = []
        batch: list[str] = []
        held = 0
        for k, text in enumerate(texts):
            totals.append(0)
            for part in self.parts(text):
                owners.append(k)
                batch.append(part)
                held += len(part)
                if held >= self.batch_bytes:
                    self._flush(totals, owners, batch)
                    held = 0
        self._flush(totals, owners, batch)
        return totals

    def _flush(self, totals: list[int], owners: list[int], batch: list[str]) -> None:
        for k, ids in zip(owners, self.model.encode(batch, num_threads=1), strict=True):
            totals[k] += len(ids)
        owners.clear()
        batch.clear()


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens.  Null or repeated identifiers pass
    through; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, batch_bytes)
        for batch in batches:
            ids: list = []
            texts: list[str] = []
            sizes: list[int] = []
            out = Out(SCHEMA)
            held = 0

            def flush() -> None:
                for doc_id, size, n in zip(ids, sizes, counter.counts(texts), strict=True):
                    out.add(doc_id, size, n, n > limit)
                ids.clear(), texts.clear(), sizes.clear()

            for doc_id, text in rows_of(batch, "doc_id", "text"):
                ids.append(doc_id)
                texts.append(text)
                sizes.append(len(text.encode()))
                held += sizes[-1]
                if held >= batch_bytes:
                    flush()
                    held = 0
            flush()
            if len(out):
                yield out.take()

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
