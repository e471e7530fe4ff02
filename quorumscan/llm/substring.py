"""Removal of repeated passages by sharded Aho-Corasick automata.

A window is ``width`` consecutive words of a document.  Every word that lies in a window
whose words also start earlier (in a smaller identifier, or earlier in the same document) goes.

1. Phrases.  Of the ``phrase``-word phrases inside a window the one with the smallest hash
   is the window's phrase.  Equal windows have equal phrases, so only windows whose phrase
   occurs more than once can recur; that is one phrase in about seven words to count.
2. Segments.  Around each recurring phrase the words of all windows that it stands for are
   cut out.  Equal segments become one row with their earliest place, so a passage that is
   in a third of all documents costs one row per task.  Phrases with more than ``hot``
   occurrences are cut into single windows keyed by themselves, which bounds every group.
3. Automata.  Segments are dealt out by phrase, so that each task is a shard.  It takes blocks of
   bounded size: windows whose hashes recur are entered word by word, with their earliest place, in
   an automaton over word numbers, and all segments stream through it.  What it reports is every
   occurrence; those of other places than the earliest are later ones.  A segment stands for all documents
   that have it, so every word of a document that can be covered passes an automaton, and no other word needs to.
4. Documents get the places of their later occurrences back and drop the covered words.

Only documents that hold a recurring phrase are shuffled, as far as a broadcast bitmap of
fixed size can tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import Out, drop_written, groups_of, mark_members, rows_of, text_of, written

#: Identifier that stands for null in the order of documents: it comes last.
LAST = (1 << 63) - 1
PHRASES = pa.schema([("phrase", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
SEGMENTS = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.string())])
LOCATED = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc1", pa.int64()), ("row1", pa.int64()), ("start1", pa.int32()), ("later", pa.int32())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


@dataclass
class Phrases:
    """The phrases that the windows of some texts stand under, as arrays of one entry each."""

    hashes: np.ndarray
    text: np.ndarray  #: number of the text
    pos: np.ndarray  #: word at which the phrase starts
    first: np.ndarray  #: first and last word at which a window of the phrase starts
    last: np.ndarray


def phrases_of(texts: list[str], width: int, phrase: int) -> Phrases:
    """Words are split and numbered by Arrow, so that each distinct word is hashed once."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts, pa.string())))
    numbered = words.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.array([digest(w) for w in numbered.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    h = distinct[numbered.indices.to_numpy()] if len(distinct) else distinct
    offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < width:
        return Phrases(none.view(np.uint64), none, none, none, none)
    mixed = np.zeros(n - phrase + 1, np.uint64)
    for k in range(phrase):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[k : n - phrase + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    # The leftmost of the smallest in each window, by doubling the span that is looked at.
    place = np.arange(len(mixed))
    span, best = 1, place
    while span < width - phrase + 1:
        step = min(span, width - phrase + 1 - span)
        a, b = best[:-step], best[step:]
        best = np.where(mixed[b] < mixed[a], b, a)
        span += step
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[: n - width + 1]
    starts = np.flatnonzero(np.arange(n - width + 1) + width <= offsets[1:][text])  # windows within one text
    chosen, text = best[starts], text[starts]
    if not len(starts):
        return Phrases(none.view(np.uint64), none, none, none, none)
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(starts)] - 1
    base = offsets[text[at]]
    return Phrases(mixed[chosen[at]], text[at], chosen[at] - base, starts[at] - base, starts[end] - base)


def coded(segments: list[tuple]) -> list[str]:
    """The words of each segment, the last of its fields, as one character a word."""
    codes: dict[str, str] = {}
    out = []
    for *_, words in segments:
        listed = words.split(" ")
        for w in listed:
            if w not in codes:
                k = len(codes) + 1
                codes[w] = chr(k if k < 0xD800 else k + 0x800)  # no surrogates
        out.append("".join(map(codes.__getitem__, listed)))
    return out


def recurring_windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and offset of every window whose hash another window of the texts has too."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(chars) - width + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes += chars[k : n + k]
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    end = np.cumsum(sizes)
    at = np.flatnonzero(np.arange(n) + width <= end[text])  # windows within one text
    _, which, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    return text[at], at - (end - sizes)[text[at]]


def automaton_of(segments: list[tuple], texts: list[str], width: int) -> ahocorasick.Automaton:
    """Recurring windows of the segments, each with its earliest place (doc, row, start)."""
    automaton = ahocorasick.Automaton()
    for k, o in zip(*(x.tolist() for x in recurring_windows(texts, width)), strict=True):
        _, _, _, doc, row, start, *_ = segments[k]
        window, place = texts[k][o : o + width], (doc, row, start + o)
        known = automaton.get(window, None)
        if known is None or place < known:
            automaton.add_word(window, place)
    automaton.make_automaton()
    return automaton


def locate(segments: list[tuple], width: int) -> Iterator[tuple]:
    """Of the segments of some phrases, which windows start earlier elsewhere.

    Each item is (key, h1, h2, doc, row, start, n, words): the earliest place of a segment and
    how often it occurs.  Yields (key, h1, h2, doc, row, start, later), bit o of ``later`` set where the
    window o words in has an earlier place in another segment.
    """
    texts = coded(segments)
    automaton = automaton_of(segments, texts, width)
    some = len(automaton) > 0
    for (key, h1, h2, doc, row, start, *_), text in zip(segments, texts, strict=True):
        later = 0
        for end, place in automaton.iter(text) if some else ():
            o = end - width + 1
            if place != (doc, row, start + o):
                later |= 1 << o
        yield key, h1, h2, doc, row, start, later


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc: the identifier in order, null last; row: a hash of the text, which tells rows of one identifier apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"))


def recurring_places(phrases: DataFrame, recurring: DataFrame) -> DataFrame:
    """doc, row and places: 2 * pos + 1 if the phrase there counts as hot, of all recurring phrases.

    A phrase that is not hot has few rows, so its join has no skew.  Hot phrases are told by
    a bitmap alone and joined with nothing.  The bitmap answers alike wherever a phrase
    stands, and a phrase taken for hot that is not only has its windows cut apart.
    """
    rows = mark_members(phrases, recurring, "phrase").filter("_member").drop("_member")
    rows = mark_members(rows, recurring.filter("is_hot"), "phrase")
    cool = rows.filter("not _member").join(recurring.select("phrase"), "phrase", "left_semi")
    both = cool.unionByName(rows.filter("_member"))
    return both.groupBy("doc", "row").agg(F.collect_list(F.col("pos") * 2 + F.col("_member").cast("int")).alias("places"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, phrase: int = 8, hot: int = 4096, block: int = 4096, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text if ``with_text``.

    Words are runs of anything but ASCII white space, compared unchanged; null texts have
    none; texts of any length are taken whole.  Windows are judged on the input.  Rows with a null identifier come after all
    others; rows of one identifier are ordered by a hash of their texts, and rows that
    repeat identifier and text are one document whose result each of them gets.  Documents
    under ``width`` words lose nothing.  An empty table gives no rows; other columns are
    ignored.
    """
    if not 1 <= phrase <= width or width - phrase > 30:
        raise ValueError("a phrase lies within a window, and a phrase stands for up to 31 windows")
    rows = _ordered(docs, id_col, text_col)

    def find_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups_of(batch, "doc", "row", "text"):
                found = phrases_of([text for _, _, text in group], width, phrase)
                docs_of, rows_of_docs = (np.array([g[k] for g in group], np.int64)[found.text] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes.view(np.int64)), pa.array(docs_of), pa.array(rows_of_docs), pa.array(found.pos.astype(np.int32))], schema=PHRASES)

    phrases = written(rows.select("doc", "row", "text").mapInArrow(find_phrases, "phrase long, doc long, row long, pos int"), "phrases")
    recurring = written(phrases.groupBy("phrase").count().filter("count > 1").select("phrase", (F.col("count") > hot).alias("is_hot")), "recurring-phrases")
    places = written(recurring_places(phrases, recurring), "places")
    drop_written(phrases)
    drop_written(recurring)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups_of(batch, "doc", "row", "places", "text"):
                found = phrases_of([g[3] for g in group], width, phrase)
                bounds = np.searchsorted(found.text, np.arange(len(group) + 1))
                columns: list[list] = [[] for _ in SEGMENTS]
                for (doc, row, at, text), lo, hi in zip(group, bounds, bounds[1:]):
                    codes = np.sort(np.array(at, np.int64))
                    mine = slice(lo, hi)
                    near = np.minimum(np.searchsorted(codes, found.pos[mine] * 2), len(codes) - 1)
                    on = codes[near] >> 1 == found.pos[mine]
                    alone = on & (codes[near] & 1 == 1)
                    whole = on & ~alone
                    starts, ends, keys = found.first[mine][whole].tolist(), found.last[mine][whole].tolist(), found.hashes[mine][whole].view(np.int64).tolist()
                    for a, b in zip(found.first[mine][alone].tolist(), found.last[mine][alone].tolist()):
                        starts += range(a, b + 1)
                        ends += range(a, b + 1)
                    words = text.encode().split()
                    joined = b" ".join(words)
                    edges = [0, *accumulate(len(w) + 1 for w in words)]
                    cuts = [joined[edges[a] : edges[b + width] - 1] for a, b in zip(starts, ends)]
                    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cuts)), np.int64).reshape(-1, 2).T.tolist() if cuts else ([], [])
                    n = len(cuts)
                    own = (keys + digests[0][len(keys) :], *digests, [doc] * n, [row] * n, starts, [b - a + 1 for a, b in zip(starts, ends)], cuts)
                    for column, values in zip(columns, own, strict=True):
                        column += values
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENTS, strict=True)], schema=SEGMENTS)

    touched = mark_members(rows.select("doc", "row", "text"), places, "doc").filter("_member").drop("_member")
    ddl = "key long, h1 long, h2 long, doc long, row long, start int, windows int, words string"
    segments = written(touched.join(places, ["doc", "row"]).select("doc", "row", "places", "text").mapInArrow(cut, ddl), "segments")
    drop_written(places)
    place = F.struct("doc", "row", "start")
    contents = segments.groupBy("key", "h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    contents = contents.select("key", "h1", "h2", "at.doc", "at.row", "at.start", "n", "words")

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(LOCATED)
        held: list[tuple] = []  # segments of phrases that have several
        group: list[tuple] = []  # segments of the phrase at hand

        def close() -> None:
            if len(group) > 1:
                held.extend(group)
            else:  # windows under one place of a phrase differ from each other
                out.add(*group[0][:6], 0)
            group.clear()

        for batch in batches:
            for row in rows_of(batch, "key", "h1", "h2", "doc", "row", "start", "n", "words"):
                if group and group[0][0] != row[0]:
                    close()
                    if len(held) >= block:
                        for found in locate(held, width):
                            out.add(*found)
                        held.clear()
                    if out.full():
                        yield out.take()
                group.append(row)
        if group:
            close()
        for found in locate(held, width) if held else ():
            out.add(*found)
        if len(out):
            yield out.take()

    ddl = "key long, h1 long, h2 long, doc1 long, row1 long, start1 int, later int"
    located = contents.repartition("key").sortWithinPartitions("key").mapInArrow(automata, ddl)
    first = (F.col("doc") == F.col("doc1")) & (F.col("row") == F.col("row1")) & (F.col("start") == F.col("start1"))
    gone = F.when(first, F.col("later")).otherwise(F.expr("cast(shiftleft(1L, windows) - 1 as int)"))
    marks = segments.drop("words").join(located, ["key", "h1", "h2"]).select("doc", "row", "start", gone.alias("later")).filter("later != 0")
    marks = written(marks.groupBy("doc", "row").agg(F.collect_list(F.expr("shiftleft(cast(start AS long), 32) | later")).alias("marks")), "marks")
    drop_written(segments)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Out(KEPT)
            for doc_id, at, text in rows_of(batch, "doc_id", "marks", "text"):
                words = text.encode().split()
                n = len(words)
                if at:
                    codes = np.array(at, np.int64)
                    starts, later = codes >> 32, codes & 0xFFFFFFFF
                    edges = np.zeros(n + 1, np.int32)
                    for o in range(int(later.max()).bit_length()):
                        hit = starts[later >> o & 1 == 1] + o
                        np.add.at(edges, hit, 1)
                        np.add.at(edges, hit + width, -1)
                    kept = np.cumsum(edges[:n]) == 0
                    words = [w for w, k in zip(words, kept.tolist()) if k]
                joined = b" ".join(words)
                out.add(doc_id, n, n - len(words), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None)
            if len(out):
                yield out.take()

    split = mark_members(rows, marks, "doc")
    hit = split.filter("_member").join(marks, ["doc", "row"], "left").select("doc_id", "marks", "text")
    free = split.filter("not _member").select("doc_id", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"), "text")
    out = hit.unionByName(free).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
