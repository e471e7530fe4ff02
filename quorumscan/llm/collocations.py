"""Phrase collocations: count-min sketches first, exact counts of the survivors second.

1. Every task counts its phrases in a count-min sketch, a row of counters for each number of words.  Words and pairs come first, then triples
   whose pairs may both be frequent, then longer phrases whose triples may, so few phrases beyond the frequent ones are counted at all.  A task
   sends only the cells that it has counted in, as differences, so what is sent follows its text and not the sketch's width.  The tasks' cells are
   added up a block of cells at a time, in streams.  A sketch never counts too little, so a phrase whose cell reaches the least count may be
   frequent, and any other is not.  What later passes are given is one bit a cell: whether it reaches that count.
2. The last pass reads the texts again, drops every phrase that has a cell below the count, or whose
   shorter parts have, and aggregates the rest exactly, as strings: first a task's own, then all tasks' by parts of the phrases.  Nothing
   frequent is lost.
3. Cuts of a phrase are scored by joins of the exact counts, and phrases subsumed by a longer one go.

The sketch's width follows the characters of the table up to ``MOST_CELLS``, so tasks hold and the driver broadcasts
a bounded amount; beyond, more infrequent phrases pass to the exact aggregation, and results are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumscan.llm.common import text_of, written
from quorumscan.llm.words import Words, byte_set, mixed, texts_of, words_of

#: Fixed bytes of the definition: what ends a piece, and what else parts words.
BREAKS = byte_set([*b".,;:!?", *range(0x0A, 0x0E)])
SEPARATORS = BREAKS | byte_set(b" \t")
#: Counters of a row of the sketch at least and at most; 1 bit each in the broadcast.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
#: Characters of the table for each counter.
CHARS_A_CELL = 40
#: Cells that are merged at a time, at least, and blocks of a row at most.
BLOCK, MOST_BLOCKS = 1 << 16, 256
#: Cells that a task holds before they are added up.
HELD_CELLS = 1 << 22
#: Bytes of texts that are counted at a time.
GROUP_BYTES = 4 << 20
#: Counts that a task holds before they are added up.
HELD_ROWS = 1 << 21
#: Parts of the phrases that are added up apart: one for each 2**PART_BITS characters, within bounds.
LEAST_PARTS, MOST_PARTS, PART_BITS = 16, 4096, 23
#: Parts into which a language's candidates are dealt before they are ranked.
DEALT = 64


def _languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) & np.uint64(width - 1)).astype(np.int64)


def _grams(words: Words, languages: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every number of words up to ``size``: whether a phrase starts at each word, and its hash."""
    one = words.hashes()[words.word]
    h, ok = mixed(one + languages), np.ones(len(one), bool)
    for n in range(1, size + 1):
        if n > 1:
            ahead = len(one) - n + 1
            if ahead <= 0:
                return
            h = mixed(h[:ahead] * np.uint64(0x9FB21C651E98DF25) + one[n - 1 :])
            ok = words.piece[:ahead] == words.piece[n - 1 :]
        yield n, ok, h


def _read(rows: list[tuple]) -> tuple[Words, np.ndarray, list[str]]:
    """Words of a group (lang, text), the number of each word's language, and the languages."""
    words = words_of([t for _, t in rows], SEPARATORS, BREAKS)
    names = sorted({lang for lang, _ in rows})
    number = {x: k for k, x in enumerate(names)}
    return words, np.array([number[lang] for lang, _ in rows], np.int64)[words.text], names


def _language_hash(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(zlib.crc32(x.encode()).to_bytes(4, "big") + zlib.adler32(x.encode()).to_bytes(4, "big"), "big") for x in names], np.uint64)


def _candidates(words: Words, languages: np.ndarray, bits: list[np.ndarray], width: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every number of words up to ``size``: the places of phrases that may be frequent, by the sketch's bits as far as there are any
    and by their shorter parts, and the hashes of all."""
    alive = None
    for n, ok, h in _grams(words, languages, size):
        # Parts of a phrase are as frequent as it is, so one whose parts are not alive is left out.
        ok = ok if alive is None else ok & alive[: len(ok)] & alive[1 : len(ok) + 1]
        at = np.flatnonzero(ok)
        if n <= len(bits):
            cell = _cells(h[at], n, width)
            at = at[(bits[n - 1][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
        if not len(at):
            return
        yield n, at, h
        alive = np.zeros(len(ok), bool)
        alive[at] = True


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order, each once, with the sums of their counts."""
    cells, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    return cells[first], np.add.reduceat(counts, first) if len(first) else counts


def _bytes_apart(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte: first the lowest of each."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def merged_sketch(texts: DataFrame, sizes: list[int], bits: list[np.ndarray], width: int, least: int) -> list[np.ndarray]:
    """Of each of ``sizes``' row of the sketch of candidates, the packed bits of the cells that reach ``least``; ``bits`` are those of smaller sizes."""
    block = min(width, max(BLOCK, width // MOST_BLOCKS))
    known = texts.sparkSession.sparkContext.broadcast(bits)

    def sent(cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        number = cells // block
        cuts = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            data = press.compress(_bytes_apart(np.diff(cells[a:b], prepend=number[a] * block)) + _bytes_apart(np.minimum(counts[a:b], least)))
            yield pa.RecordBatch.from_pydict({"cell": [int(number[a]) * block], "counts": [data]}, pa.schema([("cell", pa.int64()), ("counts", pa.binary())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for rows in texts_of(batches, BREAKS, GROUP_BYTES, "lang"):
            words, lang, names = _read(rows)
            if not len(words.word):
                continue
            for n, at, h in _candidates(words, _language_hash(names)[lang], known.value, width, sizes[-1]):
                if n >= sizes[0]:
                    held.append(np.unique(_cells(h[at], n, width) + (n - sizes[0]) * width, return_counts=True))
                    n_held += len(held[-1][0])
            if n_held > HELD_CELLS:
                held = [_summed(held)]
                n_held = len(held[0][0])
                if n_held > HELD_CELLS // 2:
                    yield from sent(*held[0])
                    held, n_held = [], 0
        if held:
            yield from sent(*_summed(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, so one block of counters is held at a time."""

        def done(cell: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"cell": [cell], "bits": [np.packbits(total >= least).tobytes()]}, pa.schema([("cell", pa.int64()), ("bits", pa.binary())]))

        unpress = zstandard.ZstdDecompressor()
        at, total = None, None
        for batch in batches:
            for cell, data in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if cell != at:
                    if at is not None:
                        yield done(at, total)
                    at, total = cell, np.zeros(block, np.int64)
                raw = np.frombuffer(unpress.decompress(data), np.uint8).reshape(2, 4, -1)
                places, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
                total[np.cumsum(places, dtype=np.int64)] += counts
        if at is not None:
            yield done(at, total)

    sketches = texts.mapInArrow(count, "cell long, counts binary")
    merged = sketches.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, "cell long, bits binary")
    out = [np.zeros(width // 8, np.uint8) for _ in sizes]
    for row in merged.collect():  # of bounded size: a bit for each cell
        r, k = divmod(row.cell, width)
        out[r][k // 8 : (k + block) // 8] = np.frombuffer(row.bits, np.uint8)
    known.unpersist()
    return out


def _added(batches: list[pa.RecordBatch]) -> pa.Table:
    """Rows (lang, size, phrase, f), equal ones as one."""
    total = pa.Table.from_batches(batches).group_by(["lang", "phrase"]).aggregate([("size", "min"), ("f", "sum")])
    columns = [total.column(c) for c in ("lang", "size_min", "phrase", "f_sum")]
    return pa.Table.from_arrays(columns, names=["lang", "size", "phrase", "f"])


def sketch_width(chars: int) -> int:
    """A power of two by the number of characters, within bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (chars // CHARS_A_CELL).bit_length()))


def frequent_phrases(docs: DataFrame, least: int, size: int = 5, text_col: str = "text", lang_col: str = "lang", width: int | None = None) -> DataFrame:
    """(lang, size, phrase, f) of every phrase with ``least`` occurrences or more, and of size 0 every language's number of words.

    Null languages are ``und``, null texts have no words; repeated rows count each.  ``width`` sets
    the cells of a row of the sketch instead of the table's characters.
    """
    texts = _languages(docs, text_col, lang_col)
    spark: SparkSession = docs.sparkSession
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    width = width or sketch_width(chars)
    bits: list[np.ndarray] = []
    for sizes in ([1, 2], [3], list(range(4, size + 1))):
        if sizes := [n for n in sizes if n <= size]:
            bits += merged_sketch(texts, sizes, bits, width, least)
    known = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in texts_of(batches, BREAKS, GROUP_BYTES, "lang"):
            words, lang, names = _read(rows)
            total = np.bincount(lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(total)], schema=schema)
            if not len(words.word):
                continue
            texts_by_number, n_words = words.names.cast(pa.string()), len(words.names)
            number = lang
            for n, at, h in _candidates(words, _language_hash(names)[lang], known.value, width, size):
                # A phrase is numbered by the number of its beginning and its last word: exact, whatever the hashes.
                codes, _ = pd.factorize(number[at] * n_words + words.word[at + n - 1])
                counts = np.bincount(codes)
                first = np.empty(len(counts), np.int64)
                first[codes[::-1]] = at[::-1]
                number = np.zeros(len(h), np.int64)
                number[at] = codes
                parts = [texts_by_number.take(pa.array(words.word[first + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[first])), pa.array(np.full(len(first), n, np.int32)), phrase, pa.array(counts.astype(np.int64))], schema=schema)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Counts of a task, added up; what is held is bounded."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in survivors(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD_ROWS:
                table = _added(held)
                if table.num_rows > HELD_ROWS // 2:
                    yield table
                    table = table.slice(0, 0)
                held, rows = table.to_batches(), table.num_rows
        if held:
            yield _added(held)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts by parts of the phrases, one row a part."""
        out = pa.schema([("part", pa.int32()), ("data", pa.binary())])
        for table in combined(batches):
            part = (pd.util.hash_array(table.column("phrase").to_numpy()) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            table, cuts = table.take(pa.array(order)).combine_chunks(), np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(table.slice(cuts[k], cuts[k + 1] - cuts[k]))
                yield pa.RecordBatch.from_pydict({"part": [k], "data": [sink.getvalue().to_pybytes()]}, out)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, so one part's phrases are held at a time."""

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _added(held)
            yield from total.filter(pc.or_(pc.greater_equal(total.column("f"), least), pc.equal(total.column("size"), 0))).cast(schema).to_batches(1 << 16)

        at, held, rows = None, [], 0
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part != at:
                    if held:
                        yield from done(held)
                    at, held, rows = part, [], 0
                more = pa.ipc.open_stream(data).read_all()
                held += more.to_batches()
                rows += more.num_rows
                if rows > HELD_ROWS:
                    held = _added(held).to_batches()
                    rows = 0
        if held:
            yield from done(held)

    parts = min(MOST_PARTS, max(LEAST_PARTS, chars >> PART_BITS))
    rows = texts.mapInArrow(packed, "part int, data binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(merged, "lang string, size int, phrase string, f long")


def collocations(docs: DataFrame, least: int = 100, best: int | None = 2000, size: int = 5, share: int = 100, text_col: str = "text", lang_col: str = "lang", width: int | None = None) -> DataFrame:
    """The ``best`` phrases of two to ``size`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    A phrase is a candidate from ``least`` occurrences (a) on.  Of its cuts into a first part (l) and a rest (r) that of the lowest
    score, ``floor(1000 a n / (l r))`` with the language's number of words n, counts, of equal ones the first.  A candidate inside a longer one that has
    ``share`` per cent of its occurrences goes.  All numbers are exact: products are decimals of 38 digits.
    ``best`` None ranks all.

    Null languages are ``und``; null and empty texts have no words; texts of any length are read whole; repeated rows
    count each; ties are ordered by a, then phrase by bytes; an empty table gives no rows; other columns are ignored.
    """
    grams = written(frequent_phrases(docs, least, size, text_col, lang_col, width), "phrases")
    totals = written(grams.filter("size = 0").select("lang", F.col("f").alias("n")), "words")
    known = grams.filter("size > 0").select("lang", "phrase", "f")
    candidates = grams.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(begin: str, length: str) -> Column:
        return F.expr(f"array_join(slice(w, {begin}, {length}), ' ')")

    # Of equal shares only the next longer phrases matter: occurrences never grow with length.  Below 100 per cent all longer ones do.
    longer = candidates.filter("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    longer = longer.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    inner = longer.groupBy("lang", part("at", "k").alias("phrase")).agg(F.max("a").alias("most"))
    alone = candidates.join(inner, ["lang", "phrase"], "left").filter(f"most IS NULL OR CAST(100 AS decimal(20,0)) * most < CAST({int(share)} AS decimal(20,0)) * a")

    cuts = alone.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("1", "k").alias("head"), part("k + 1", "size - k").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS decimal(38,0)) * CAST(a AS decimal(20,0)) * CAST(n AS decimal(20,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("s"))
    scored = lowest.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", F.col("s.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if best is not None:
        # Ranked within parts of a language first, so that no task sorts all of one.
        dealt = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
        scored = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_k") <= best).drop("_k", "_part")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if best is None else ranked.filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
