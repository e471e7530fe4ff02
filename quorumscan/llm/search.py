"""Ranked lexical search: an inverted index of shards, searched by Block-Max WAND.

Index.  Every task reads its documents into shards of bounded size.  A shard's postings of a term
are cut into blocks of ``BLOCK`` postings.  A block keeps its first and last document, its number of postings, the
maximum impact of its postings, and the postings packed: gaps of documents and occurrences less one, each in as many bits as the block
needs.  Impacts do not depend on the terms' weights, so blocks need the numbers of documents and terms alone.

Search.  Queries come in blocks of bounded size and are broadcast; blocks of their terms meet their shards.
In a shard, lists are moved over windows of documents together.  The pivot test of WAND is made for
all documents of a window at once: lists are ordered by their block maxima there, and those that do not reach the threshold together
cannot make a document a result; without any other list the window is skipped.  Candidates, the documents of the other lists,
are held against the block maxima of the lists left (a shallow move: only the blocks' ends and maxima are read).
Only blocks that a candidate above the threshold lies in are unpacked, list by list, the heaviest first,
and each actual impact that replaces a maximum may rule candidates out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumscan.llm.common import pick, text_of, written
from quorumscan.llm.words import byte_set, cut, words_of

#: Bytes that part terms: ASCII but letters and digits.
SEPARATORS = byte_set(b for b in range(128) if not chr(b).isalnum())
BLOCK = 128
#: Bytes of texts and number of documents that fill a shard.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Documents of a window at first and at most; windows grow as the threshold does.
FIRST_WINDOW, WINDOW = 1 << 11, 1 << 13
#: Of so many candidates for each result the best are taken first.
MANY = 100
#: Characters of the queries that are broadcast at a time, and their number.
QUERY_CHARS, QUERIES = 1 << 22, 4096

INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("most", pa.int64()), ("bits", pa.int32()), ("data", pa.binary())])
DOCS = pa.schema([("doc", pa.int32()), ("doc_id", pa.int64()), ("m", pa.int64())])
HITS = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with, by its occurrences and the document's length value."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_values(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 100 - 90 + 90 * n * documents // max(1, terms)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# -- packed blocks ---------------------------------------------------------------------------


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that each of the values needs, from 0."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of numbers in ``bits`` bits each; their number in a row is a multiple of eight."""
    if not bits:
        return np.zeros((len(values), 0), np.uint8)
    spread = (values[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(len(values), -1), axis=1)


def unpacked(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Numbers out of one row of ``packed``."""
    if not bits:
        return np.zeros(n, np.int64)
    return np.unpackbits(data)[: n * bits].reshape(n, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _blocks(starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Both widths, as one number, and the bytes of each block of postings; blocks of the same shape are packed together."""
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = 0
    n = ends - starts
    shape = np.stack([_width(np.maximum.reduceat(gaps, starts)), _width(np.maximum.reduceat(tf - 1, starts)), (n + 7) // 8 * 8])
    out: list[bytes] = [b""] * len(starts)
    kinds, which = np.unique(shape, axis=1, return_inverse=True)
    which = which.ravel()
    for k, (a, b, long) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero(which == k)
        at = starts[rows][:, None] + np.arange(long)
        inside = at < ends[rows][:, None]
        at = np.minimum(at, len(docs) - 1)
        data = np.hstack([packed(np.where(inside, gaps[at], 0), a), packed(np.where(inside, tf[at] - 1, 0), b)])
        for row, line in zip(rows.tolist(), data, strict=True):
            out[row] = line.tobytes()
    return shape[0] * 64 + shape[1], out


def postings(data: bytes, bits: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and occurrences of a packed block."""
    a, b = divmod(bits, 64)
    long = (n + 7) // 8 * 8
    raw = np.frombuffer(data, np.uint8)
    return first + np.cumsum(unpacked(raw[: long * a // 8], a, n)), unpacked(raw[long * a // 8 :], b, n) + 1


# -- index -----------------------------------------------------------------------------------


@dataclass
class Index:
    """Written tables of an index: ``blocks`` of postings and ``docs`` of every shard, with the table's totals."""

    blocks: DataFrame
    docs: DataFrame
    documents: int
    terms: int


def _counted(group: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of terms, then term, document and occurrences of each posting by term and document, and each document's length.

    Parts of a text are read one by one; a group is (doc_id, parts of its text).
    """
    flat = [(k, part) for k, (_, parts) in enumerate(group) for part in parts]
    words = words_of([p for _, p in flat], SEPARATORS)
    doc = np.array([k for k, _ in flat], np.int64)[words.text] if flat else np.zeros(0, np.int64)
    key, tf = np.unique(words.word.astype(np.int64) * max(1, len(group)) + doc, return_counts=True)
    term, doc_of = np.divmod(key, max(1, len(group)))
    return words.names, term, doc_of, tf.astype(np.int64), np.bincount(doc, minlength=len(group))


def _shards(batches: Iterator[pa.RecordBatch], most_bytes: int, most_docs: int) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    held = 0
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for k in range(batch.num_rows):
            text = texts[k].as_py().encode()
            group.append((ids[k].as_py(), list(cut(text, SEPARATORS, most_bytes))))
            held += len(text)
            if held >= most_bytes or len(group) >= most_docs:
                yield group
                group, held = [], 0
    if group:
        yield group


def totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Documents that hold a term, and terms with repeats."""
    schema = pa.schema([("documents", pa.int64()), ("terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _shards(batches, SHARD_BYTES, SHARD_DOCS):
            *_, n = _counted(group)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], schema=schema)

    found = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "documents long, terms long")
    return tuple(x or 0 for x in found.agg(F.sum("documents"), F.sum("terms")).first())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """An index of every row of ``docs``; null texts have no terms and are held by no list.

    A shard has the rows of one task up to ``shard_bytes`` of texts, or a single longer text, and ``shard_docs`` rows at most.
    """
    documents, terms = totals(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for seq, group in enumerate(_shards(batches, shard_bytes, shard_docs)):
            shard = (TaskContext.get().partitionId() << 24) + seq
            group.sort(key=lambda row: (row[0] is None, row[0] or 0))
            names, term, doc, tf, n = _counted(group)
            m = length_values(n, documents, terms)
            none = pa.nulls(len(group))
            ids = pa.array([i for i, _ in group], pa.int64())
            yield _rows(len(group), shard=shard, doc=np.arange(len(group), dtype=np.int32), doc_id=ids, m=m, term=none.cast(pa.string()))
            if not len(term):
                continue
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            sizes = np.diff(np.append(begins, len(term)))
            each = (sizes + BLOCK - 1) // BLOCK
            of = np.repeat(np.arange(len(begins)), each)
            starts = begins[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each))
            ends = np.minimum(starts + BLOCK, begins[of] + sizes[of])
            most = np.maximum.reduceat(impacts(tf, m[doc]), starts)
            bits, data = _blocks(starts, ends, doc, tf)
            text = names.cast(pa.string()).take(pa.array(term[starts]))
            for k in range(0, len(starts), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield _rows(len(starts[s]), shard=shard, term=text[s], first=doc[starts[s]], last=doc[ends[s] - 1], n=(ends - starts)[s], most=most[s], bits=bits[s], data=pa.array(data[s], pa.binary()))

    both = pa.unify_schemas([INDEX, DOCS])

    def _rows(count: int, **columns: object) -> pa.RecordBatch:
        columns["shard"] = np.full(count, columns["shard"])
        arrays = [pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in both]
        return pa.RecordBatch.from_arrays(arrays, schema=both)

    kind = "shard long, term string, first int, last int, n int, most long, bits int, data binary, doc int, doc_id long, m long"
    rows = written(pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, kind), "postings")
    return Index(rows.filter("term IS NOT NULL").select(*INDEX.names), rows.filter("term IS NULL").select(F.col("shard").alias("in_shard"), "doc", "doc_id", "m"), documents, terms)


# -- search ----------------------------------------------------------------------------------


class PostingList:
    """Blocks of a term in a shard: ends and maxima at once, postings of a block when they are asked for."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray, most: np.ndarray, bits: np.ndarray, data: list[bytes], m: np.ndarray) -> None:
        self.first, self.last, self.n, self.most, self.bits, self.data, self.m = first, last, n, most, bits, data, m
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if k not in self.open:
            doc, tf = postings(self.data[k], int(self.bits[k]), int(self.first[k]), int(self.n[k]))
            self.open[k] = doc, impacts(tf, self.m[doc])
        return self.open[k]

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """Blocks that reach into documents from begin to end."""
        return int(np.searchsorted(self.last, begin)), int(np.searchsorted(self.first, end))

    def bound(self, begin: int, end: int) -> int:
        a, b = self.span(begin, end)
        return int(self.most[a:b].max()) if a < b else 0

    def within(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(*self.span(begin, end)):
            doc, impact = self.block(k)
            a, b = np.searchsorted(doc, (begin, end))
            yield doc[a:b], impact[a:b]

    def shallow(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block where each document may be, or -1, and that block's maximum."""
        k = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        there = (self.first[k] <= docs) & (docs <= self.last[k])
        return np.where(there, k, -1), np.where(there, self.most[k], 0)

    def at(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of documents, whose blocks are known; 0 where the term is not."""
        out = np.zeros(len(docs), np.int64)
        for k in np.unique(blocks[blocks >= 0]).tolist():
            doc, impact = self.block(k)
            mine = np.flatnonzero(blocks == k)
            p = np.minimum(np.searchsorted(doc, docs[mine]), len(doc) - 1)
            out[mine] = np.where(doc[p] == docs[mine], impact[p], 0)
        return out


def search_shard(lists: list[tuple[int, PostingList]], size: int, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best of a shard of ``size`` documents, those with scores above 0.

    ``lists`` are (weight, list).  Of equal scores the lowest ``order`` wins, which is by document.
    """
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, begin, width = 1, 0, FIRST_WINDOW

    def taken(found: np.ndarray, exact: np.ndarray) -> None:
        nonlocal docs, scores, least
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, exact])
        top = np.lexsort((order[docs], -scores))[:k]
        docs, scores = docs[top], scores[top]
        least = max(1, int(scores[-1])) if len(docs) == k else 1

    while begin < size:
        end = min(begin + width, size)
        bounds = [w * x.bound(begin, end) for w, x in lists]
        by = [j for j in np.argsort(bounds, kind="stable").tolist() if bounds[j]]
        reach = np.cumsum([bounds[j] for j in by])
        # The pivot: lists before it do not reach the threshold together.
        pivot = int(np.searchsorted(reach, least))
        if pivot < len(by):
            partial = np.zeros(end - begin, np.int64)
            for j in by[pivot:]:
                w, x = lists[j]
                for doc, impact in x.within(begin, end):
                    partial[doc - begin] += w * impact
            found = np.flatnonzero((partial > 0) & (partial + (reach[pivot - 1] if pivot else 0) >= least))
            candidates = Candidates(found + begin, partial[found], [lists[j] for j in by[:pivot][::-1]])
            # Those of the highest bounds first: they raise the threshold for the others.
            if len(found) > MANY * k:
                by_bound = np.argsort(-candidates.bound, kind="stable")
                taken(*candidates.select(by_bound[: 2 * k]).exact(least))
                candidates = candidates.select(by_bound[2 * k :])
            taken(*candidates.exact(least))
        begin, width = end, min(4 * width, WINDOW)
    return docs, scores


class Candidates:
    """Documents with what the pivot's lists give them, and the block maxima of the lists that are left, the heaviest first."""

    def __init__(self, docs: np.ndarray, bound: np.ndarray, lists: list[tuple[int, PostingList]]) -> None:
        self.docs, self.lists = docs, lists
        self.moves = [x.shallow(docs) for _, x in lists]
        self.bound = bound + sum((w * most for (w, _), (_, most) in zip(lists, self.moves, strict=True)), np.zeros(len(docs), np.int64))

    def select(self, which: np.ndarray) -> Candidates:
        out = object.__new__(Candidates)
        out.docs, out.bound, out.lists = self.docs[which], self.bound[which], self.lists
        out.moves = [(block[which], most[which]) for block, most in self.moves]
        return out

    def exact(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose scores reach ``least``, and their scores; blocks are unpacked only where a bound still does."""
        which = np.flatnonzero(self.bound >= least)
        bound = self.bound[which]
        for (w, x), (block, most) in zip(self.lists, self.moves, strict=True):
            if not len(which):
                break
            bound = bound + w * (x.at(self.docs[which], block[which]) - most[which])
            keep = np.flatnonzero(bound >= least)
            which, bound = which[keep], bound[keep]
        return self.docs[which], bound


def _searcher(asked: Broadcast, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of one shard: its blocks of the queries' terms, and its documents."""

    def run(blocks: pa.Table, docs: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([], HITS)
        docs = docs.sort_by("doc")
        m, ids = docs.column("m").to_numpy(), docs.column("doc_id").combine_chunks()
        order = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
        blocks = blocks.sort_by([("term", "ascending"), ("first", "ascending")])
        names = blocks.column("term").combine_chunks().dictionary_encode()
        number = names.indices.to_numpy()
        begins = np.flatnonzero(np.diff(number, prepend=-1))
        columns = [blocks.column(c).to_numpy() for c in ("first", "last", "n", "most", "bits")]
        data = blocks.column("data").to_pylist()
        cuts = [*begins.tolist(), len(data)]
        lists = {t: PostingList(*(c[a:b] for c in columns), data[a:b], m) for t, a, b in zip(names.dictionary.to_pylist(), cuts, cuts[1:], strict=False)}
        found = [search_shard([(w, lists[t]) for t, w in query if t in lists], len(m), k, order) for query in asked.value]
        sizes = [len(d) for d, _ in found]
        doc = np.concatenate([d for d, _ in found]) if found else np.zeros(0, np.int64)
        score = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(np.repeat(np.arange(len(found), dtype=np.int32), sizes), pa.int32()), ids.take(pa.array(doc)), pa.array(score)], schema=HITS)

    return run


def _queries(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, set[str]]]]:
    """Items with their distinct terms, in groups of bounded size; items are fetched partition by partition."""
    group: list[tuple[object, set[str]]] = []
    held = 0
    for row in items.select(F.col(item_col).alias("item"), text_of(text_col).alias("text")).toLocalIterator():
        found = set(words_of([row.text.encode()], SEPARATORS).names.cast(pa.string()).to_pylist())
        group.append((row.item, found))
        held += len(row.text)
        if held >= QUERY_CHARS or len(group) >= QUERIES:
            yield group
            group, held = [], 0
    if group:
        yield group


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score.

    A term counts once in an item, however often it is there.  Of equal scores the smallest doc_id comes first, null ones last.
    Items come in groups of bounded size, each of which goes over the blocks of its own terms; items without terms, or
    whose terms no document has, give no rows; rows that repeat an item's identifier are items of their own with its identifier.
    """
    spark = index.blocks.sparkSession
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], "query int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", "score")
    for group in _queries(items, item_col, text_col):
        terms = spark.createDataFrame([(t,) for t in sorted(set().union(*(found for _, found in group)))], "term string")
        mine = index.blocks.join(F.broadcast(terms), "term")
        holding = {r.term: r.n for r in mine.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("n")).collect()}
        weights = {t: weight(index.documents, n) for t, n in holding.items()}
        asked = spark.sparkContext.broadcast([[(t, weights[t]) for t in sorted(found) if weights.get(t)] for _, found in group])

        hits = mine.groupBy("shard").cogroup(index.docs.groupBy("in_shard")).applyInArrow(_searcher(asked, k), "query int, doc_id long, score long")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        identifiers = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(group)], f"query int, item_id {kind.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(identifiers), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index all of ``docs``, then search each item: item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased; null texts
    have none.  With N documents that hold a term and L terms in all, a term that df documents hold weighs
    ``floor(1000 ln((2N + 2) / (2df + 1)))``; a document of n terms has ``m = 10 + 90 n N div L``; its score is the sum of
    ``w * ((10**9 tf) div (1000 tf + 8m))`` over the item's terms.  Texts of any length are indexed whole, repeated rows
    each for itself; empty tables give no rows; other columns are ignored.
    """
    return search(build_index(docs, id_col, text_col), items, k, item_col, item_text_col)
