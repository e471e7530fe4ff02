"""Language-model scores of documents from n-gram tries over all training text.

1. Words of the training documents are counted: their number, the number of distinct ones and, for the broadcast, the counts of those
   that have a share of 2**-20 or more, which are at most 2**20 words.
2. Every task turns its documents into positions (word before, word, word after), packs the positions of a batch by
   the shard of the middle word and sends each shard its piece.  So a shard has every context that ends in
   its words, with all that follows: its counts of words, pairs and triples are whole.
3. A shard takes its words in parts, one after the other.  It counts a part's training positions, smooths them, lays the n-grams out as a trie in
   memory-mapped levels (Elias-Fano sequences, quantised probabilities; see ``ngram_trie``) and asks the trie for every position, once for
   equal ones.  What comes back is a row for each batch: sums by document.
4. A batch's rows are added up.

The counts of all other words reach the shards that need them by another reading of the texts: each batch sends its counts of such words, and the
shards that have one as a next word, to the word's owner, a range of hashes; owners add up and answer every shard that asked.

A word with more than ``most`` occurrences is spread over shards by the word before it, so contexts of two words stay whole.  What
follows the word alone is counted before, by another reading of the texts, and every shard is given the counts of the pairs that
it has positions of.  The model is the same, whatever words are spread.

Smoothing is Witten-Bell's: a context's probability of a word is (count + t p) / (total + t), where t is the number of
different words seen behind it and p the shorter context's probability.  The shortest is the
word's own, (count + 1) / (N + V + 1), with its count in all training text, whatever its share.
Words are told apart by 64-bit hashes, as neighbours of others by 48 bits of them, and for the number of distinct ones by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import text_of, written
from quorumscan.llm.ngram_trie import Trie
from quorumscan.llm.words import Words, byte_set, mixed, texts_of, words_of

SEPARATORS = byte_set([0x20, *range(0x09, 0x0E)])
#: Words with a share of this or more are broadcast with their counts.
SHARE_BITS = 20
#: Positions of a batch, about, of a shard, and parts of a shard's words that are counted and asked one after the other.
BATCH, SHARD, PARTS = 1 << 20, 1 << 21, 4
#: Occurrences from which a word is spread over shards.
MOST = 1 << 25
GROUP_BYTES = 8 << 20
#: Hash of a document's end, which is the hash of no word, and of no word at all.
END, NONE = 2 << 16, 0
#: Neighbours of a word are told apart by so many upper bits less of their hashes.
SHORT = np.uint64(16)

#: Rows that learning leaves out: crc32 of the identifier as text leaves 2 modulo 7; null identifiers are learnt from.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2, false)"
PIECES = "shard int, data binary"
PARTIAL = pa.schema([("batch", pa.int64()), ("data", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Corpus:
    """Numbers of training tokens and of distinct ones, and the sorted hashes and counts of the frequent words."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    shards: int
    most: int
    #: Of each spread word with a word behind it: hash, positions with one, different words behind it.
    spread: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], -1)

    @property
    def rest(self) -> int:
        """Training tokens whose words are not broadcast."""
        return self.tokens - int(self.counts.sum())

    def p(self, short: np.ndarray, others: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probability of a word by itself, by its shorter hash; ``others`` are sorted shorter hashes and counts of words that are not broadcast."""
        count = np.zeros(len(short), np.int64)
        for known, counts in (others, (self.hashes >> SHORT, self.counts)):
            if len(known):
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                count = np.where(known[at] == short, counts[at], count)
        return (count + 1) / (self.tokens + self.distinct + 1)

    def shard(self, h: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The shard of positions with the words ``h``, of ``count`` occurrences, behind the words ``before``."""
        shard = (mixed(h) % np.uint64(self.shards)).astype(np.int64)
        hot = np.flatnonzero(count > self.most)
        parts = (-(-2 * count[hot] // self.most)).astype(np.uint64)
        part = mixed(before[hot] * np.uint64(31) + h[hot]) % parts
        shard[hot] = (mixed(h[hot] * np.uint64(31) + mixed(part + np.uint64(1))) % np.uint64(self.shards)).astype(np.int64)
        return shard


def _documents(docs: DataFrame, id_col: str, text_col: str, held_out: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.select("doc_id", F.expr(held_out).alias("held_out"), "text")


def _hashes(words) -> np.ndarray:
    found = words.hashes()
    found[found < 1 << 20] += np.uint64(1 << 40)
    return found


def corpus(rows: DataFrame, most: int = MOST, shard: int = SHARD) -> Corpus:
    """Counts of the training rows (held_out false), and the number of shards for all."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in texts_of(batches, SEPARATORS, GROUP_BYTES, "held_out"):
            words = words_of([t for _, t in group], SEPARATORS)
            train = ~np.array([held for held, _ in group], bool)[words.text]
            c = np.bincount(words.word[train], minlength=len(words.names))
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([words.names.take(pa.array(seen)), pa.array(c[seen])], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([int((~train).sum())], pa.int64())], schema=schema)

    words = rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = written(words, "word-counts")
    ends = rows.agg(F.count(F.lit(1)), F.count(F.when(~F.col("held_out"), 1))).first()
    found = words.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))), F.count("word"), F.sum("c")).first()
    tokens, distinct = (found[0] or 0) + ends[1], found[1] + (ends[1] > 0)
    frequent = words.filter(F.col("word").isNotNull() & (F.col("c") >= max(1, tokens >> SHARE_BITS))).toArrow()  # at most 2 ** SHARE_BITS rows
    h, c = _hashes(Words(frequent.column("word").combine_chunks(), *[None] * 3)), frequent.column("c").to_numpy()
    if ends[1] >= max(1, tokens >> SHARE_BITS):
        h, c = np.append(h, np.uint64(END)), np.append(c, ends[1])
    order = np.argsort(h)
    total = (found[2] or 0) + ends[0]
    return Corpus(tokens, distinct, h[order], c[order].astype(np.int64), max(1, -(-total // shard)), most)


# -- pieces ----------------------------------------------------------------------------------


def _planes(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers byte by byte: first the lowest byte of each, then the next, so that small ones press well."""
    a = a.astype(kind)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


class _Reader:
    """Arrays one after the other out of unpressed bytes."""

    def __init__(self, data: bytes) -> None:
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(data), 0

    def plain(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def planes(self, n: int, kind: str = "<u4") -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.plain("u1", n * size).reshape(size, n).T).view(kind).ravel()


def _piece(batch: int, docs: int, names: np.ndarray, columns: list[np.ndarray], press: zstandard.ZstdCompressor) -> bytes:
    """Positions of one batch, by middle word: names are sorted hashes, columns the numbers of the middle, left and right word and twice the
    document plus its training bit.  Hashes and a word's documents rise, so differences are kept."""
    word, counts = np.unique(columns[0], return_counts=True)
    near, number = np.unique(np.concatenate(columns[1:3]), return_inverse=True)
    doc = np.diff(columns[3].astype(np.int64), prepend=0)
    begins = np.cumsum(counts) - counts
    doc[begins] = columns[3][begins]
    head = np.array([batch, docs, len(word), len(near), len(doc)], np.int64).tobytes()
    short = names[near] >> SHORT
    parts = [np.diff(names[word], prepend=np.uint64(0)), np.diff(short, prepend=np.uint64(0))]
    return press.compress(head + b"".join(_planes(x, "<u8") for x in parts) + b"".join(map(_planes, [counts, number[: len(doc)], number[len(doc) :], doc])))


@dataclass
class Piece:
    """Positions of one batch: names of middle words and how often each comes, shorter names of neighbours, numbers of left and right ones,
    documents with the training bit."""

    batch: int
    docs: int
    names: np.ndarray
    counts: np.ndarray
    near: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray

    @staticmethod
    def open(data: bytes) -> Piece:
        r = _Reader(data)
        batch, docs, words, near, n = r.plain("<i8", 5).tolist()
        names, short = np.cumsum(r.planes(words, "<u8"), dtype=np.uint64), np.cumsum(r.planes(near, "<u8"), dtype=np.uint64)
        counts, left, right, doc = r.planes(words).astype(np.int64), r.planes(n), r.planes(n), r.planes(n).astype(np.int64)
        total = np.cumsum(doc)
        first = np.cumsum(counts) - counts
        return Piece(batch, docs, names, counts, short, left, right, (total - np.repeat(total[first] - doc[first], counts)).astype(np.uint32))

    def renumbered(self, near: np.ndarray) -> Piece:
        """The same with neighbours numbered among all of ``near``."""
        number = np.searchsorted(near, self.near).astype(np.uint32)
        return replace(self, near=near[:0], left=number[self.left], right=number[self.right])

    def part(self, k: int, parts: int) -> Piece:
        """The positions whose middle word's hash lies in one of ``parts`` equal ranges."""
        range_of = self.names >> np.uint64(65 - parts.bit_length()) if parts > 1 else np.zeros(len(self.names), np.uint64)
        a, b = np.searchsorted(range_of, [k, k + 1])
        ends = np.append(0, np.cumsum(self.counts))
        s = slice(int(ends[a]), int(ends[b]))
        return replace(self, names=self.names[a:b], counts=self.counts[a:b], left=self.left[s], right=self.right[s], doc=self.doc[s])


def _info(batch: int, ids: list, held: list[bool], tokens: list[int]) -> bytes:
    """What a batch's documents are: identifiers, marks and numbers of tokens."""
    known = np.array([i is not None for i in ids], bool)
    parts = [np.array([-1, batch, len(ids)], np.int64), np.array([i or 0 for i in ids], np.int64), known, np.array(held, bool), np.array(tokens, np.int64)]
    return b"".join(x.tobytes() for x in parts)


def _sender(known: Broadcast):
    """Documents to pieces by shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        it: Corpus = known.value
        press = zstandard.ZstdCompressor(1)
        schema = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
        ids: list = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        seq, size = TaskContext.get().partitionId() << 24, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            h = np.concatenate(tokens)
            lengths = np.array(list(map(len, tokens)))
            doc = np.repeat(np.arange(len(tokens), dtype=np.int32), lengths)
            names, word = np.unique(np.append(h, np.uint64(NONE)), return_inverse=True)  # 0 is NONE
            word = word[:-1].astype(np.int32)
            ends = np.cumsum(lengths)
            left, right = np.roll(word, 1), np.roll(word, -1)
            left[ends - lengths], right[ends - 1] = 0, 0
            count = it.count(names)
            shard = it.shard(names[word], count[word], names[left])
            order = np.argsort(shard * len(names) + word, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(it.shards + 1))
            columns = [c[order] for c in (word, left, right, 2 * doc + ~np.array(held, bool)[doc])]
            n_docs = len(tokens)
            shards, data = [seq % it.shards], [_info(seq, ids, held, lengths.tolist())]
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                shards.append(s)
                data.append(_piece(seq, n_docs, names, [c[cuts[s] : cuts[s + 1]] for c in columns], press))
            seq, size = seq + 1, 0
            ids.clear(), held.clear(), tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], schema=schema)

        for doc_ids, held_out, found in _token_hashes(batches):
            for k, h in enumerate(found):
                ids.append(doc_ids[k])
                held.append(held_out[k])
                tokens.append(h)
                size += len(h)
                if size >= BATCH:
                    yield flush()
        if ids:
            yield flush()

    return send


def _token_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bool], list[np.ndarray]]]:
    """Identifiers, held-out marks and token hashes of documents, a group at a time; parts of a long text are put together."""
    end = np.array([END], np.uint64)
    for batch in batches:
        ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        row = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], ["row", "text"])
        waiting: dict[int, list[np.ndarray]] = {}
        for group in texts_of([row], SEPARATORS, GROUP_BYTES, "row"):
            words = words_of([t for _, t in group], SEPARATORS)
            h = _hashes(words)[words.word] if len(words.word) else np.zeros(0, np.uint64)
            cuts = np.searchsorted(words.text, np.arange(len(group) + 1))
            for k, (r, _) in enumerate(group):
                waiting.setdefault(r, []).append(h[cuts[k] : cuts[k + 1]])
            done = [r for r in waiting if r < group[-1][0]]
            yield [ids[r] for r in done], [held[r] for r in done], [np.concatenate([*waiting.pop(r), end]) for r in done]
        left = list(waiting)
        yield [ids[r] for r in left], [held[r] for r in left], [np.concatenate([*waiting[r], end]) for r in left]


# -- words that are not broadcast ------------------------------------------------------------


def _asker(known: Broadcast, owners: int):
    """Documents to what owners are asked: words with training counts of a batch, and the shards that have them as next words."""

    def ask_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Corpus = known.value
        press = zstandard.ZstdCompressor(1)
        schema = pa.schema([("owner", pa.int32()), ("data", pa.binary())])
        tokens: list[np.ndarray] = []
        held: list[bool] = []

        def flush() -> pa.RecordBatch:
            lengths = np.array(list(map(len, tokens)))
            names, word = np.unique(np.concatenate(tokens), return_inverse=True)
            begins = np.cumsum(lengths) - lengths
            count = it.count(names)
            at = np.flatnonzero(count[word] < 0)
            rare, which = np.unique(word[at], return_inverse=True)  # all of them, in the order of their hashes
            trained = np.bincount(which, np.repeat(~np.array(held, bool), lengths)[at], len(rare)).astype(np.int64)
            first = np.zeros(len(word) + 1, bool)
            first[begins] = True
            which, mid = which[~first[at]], at[~first[at]] - 1
            before = np.where(first[mid], np.uint64(NONE), names[word[mid - 1]])
            asks = np.unique(which * it.shards + it.shard(names[word[mid]], count[word[mid]], before))
            which, shard = np.divmod(asks, it.shards)
            short, n_asks = names[rare] >> SHORT, np.bincount(which, minlength=len(rare))
            cuts = np.searchsorted(_owner(short, owners), np.arange(owners + 1))
            ends = np.append(0, np.cumsum(n_asks))
            tokens.clear(), held.clear()
            asked, data = np.flatnonzero(np.diff(cuts)), []
            for a, b in zip(cuts[asked].tolist(), cuts[asked + 1].tolist(), strict=True):
                mine = shard[ends[a] : ends[b]]
                head = np.array([b - a, len(mine)], np.int64).tobytes()
                data.append(press.compress(head + _planes(np.diff(short[a:b], prepend=np.uint64(0)), "<u8") + b"".join(map(_planes, (trained[a:b], n_asks[a:b], mine)))))
            return pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(data, pa.binary())], schema=schema)

        size = 0
        for _, held_out, found in _token_hashes(batches):
            for k, h in enumerate(found):
                held.append(held_out[k])
                tokens.append(h)
                size += len(h)
                if size >= BATCH:
                    yield flush()
                    size = 0
        if tokens:
            yield flush()

    return ask_for


def _owner(short: np.ndarray, owners: int) -> np.ndarray:
    """The owner of words by their shorter hashes: equal ranges of them."""
    return (((short >> np.uint64(16)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def _answered(table: pa.Table) -> pa.Table:
    """An owner's words: for each shard that asked, their sorted hashes and training counts."""
    press = zstandard.ZstdCompressor(1)
    words, counts, n_asks, shards = [], [], [], []
    for value in table.column("data"):
        r = _Reader(value.as_py())
        n, asks = r.plain("<i8", 2).tolist()
        words.append(np.cumsum(r.planes(n, "<u8"), dtype=np.uint64))
        counts.append(r.planes(n)), n_asks.append(r.planes(n)), shards.append(r.planes(asks))
    words, which = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(words)).astype(np.int64)
    asked = np.repeat(which, np.concatenate(n_asks))
    seen = total[asked] > 0  # what training has not, shards take to be 0
    shard, word = np.divmod(np.unique(np.concatenate(shards)[seen].astype(np.int64) * len(words) + asked[seen]), len(words))
    told, first = np.unique(shard, return_index=True)
    data = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(word)], strict=True):
        mine = word[a:b]
        head = np.array([-2, b - a], np.int64).tobytes()
        data.append(head + press.compress(_planes(np.diff(words[mine], prepend=np.uint64(0)), "<u8") + _planes(total[mine], "<u8")))
    return pa.Table.from_arrays([pa.array(told, pa.int32()), pa.array(data, pa.binary())], schema=pa.schema([("shard", pa.int32()), ("data", pa.binary())]))


def _other_counts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shorter hashes and counts out of all answers to a shard; no word has two owners."""
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for x in rows:
        n, r = int(np.frombuffer(x, np.int64, 2)[1]), _Reader(x[16:])
        words.append(np.cumsum(r.planes(n, "<u8"), dtype=np.uint64))
        counts.append(r.planes(n, "<u8").astype(np.int64))
    word, count = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word)
    return word[order], count[order]


# -- spread words ----------------------------------------------------------------------------


def _spread_pairs(rows: DataFrame, known: Broadcast) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, word, next, c): for each shard the pairs of a spread word and the next one that it has positions of, with their
    training positions in all shards; and the spread words with their totals and kinds."""
    schema = pa.schema([("word", pa.int64()), ("next", pa.int64()), ("shard", pa.int32()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Corpus = known.value
        for _, held, tokens in _token_hashes(batches):
            if not tokens:
                continue
            h, lengths = np.concatenate(tokens), np.array(list(map(len, tokens)))
            before, behind, train = np.roll(h, 1), np.roll(h, -1), np.repeat(~np.array(held, bool), lengths)
            ends = np.cumsum(lengths)
            before[ends - lengths], behind[ends - 1] = NONE, NONE
            c = it.count(h)
            at = np.flatnonzero((c > it.most) & (behind != NONE))
            words, word = np.unique(h[at], return_inverse=True)
            nexts, follows = np.unique(behind[at] >> SHORT, return_inverse=True)
            key, which = np.unique((word * len(nexts) + follows) * it.shards + it.shard(h[at], c[at], before[at]), return_inverse=True)
            pair, shard = np.divmod(key, it.shards)
            word, follows = np.divmod(pair, max(1, len(nexts)))
            columns = [words[word].view(np.int64), nexts[follows].view(np.int64), shard.astype(np.int32), np.bincount(which, train[at], len(key)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    here = written(rows.mapInArrow(count, "word long, next long, shard int, c long").groupBy("word", "next", "shard").agg(F.sum("c").alias("c")), "spread-pairs")
    pairs = here.groupBy("word", "next").agg(F.sum("c").alias("c")).filter("c > 0")
    found = pairs.groupBy("word").agg(F.sum("c"), F.count(F.lit(1))).orderBy("word").collect()  # fewer rows than tokens / most
    stats = [np.array([r[k] for r in found], np.int64) for k in range(3)]
    order = np.argsort(stats[0].view(np.uint64))
    return here.select("shard", "word", "next").join(pairs, ["word", "next"]).select("shard", "word", "next", "c"), (stats[0].view(np.uint64)[order], stats[1][order], stats[2][order])


# -- shards ----------------------------------------------------------------------------------


@dataclass
class Spread:
    """What a shard is told of spread words: sorted codes of pairs (word, next), their counts; by word the total and the kinds."""

    pair: np.ndarray
    count: np.ndarray
    total: np.ndarray
    kinds: np.ndarray


def build_trie(m: np.ndarray, left: np.ndarray, right: np.ndarray, told: Spread | None, p: np.ndarray, spread: np.ndarray) -> Trie:
    """A trie of training positions by numbers of words; 0 is no word.

    Positions without a word behind teach nothing, and those without one before only the word alone.  ``p`` is each word's own
    probability; ``spread`` marks words of which other shards have positions too: what follows them alone is as ``told``.
    """
    n = len(p)
    m, left, right = (x[right > 0].astype(np.int64) for x in (m, left, right))
    own = ~spread[m]
    pair, c_pair = np.unique(m[own] * n + right[own], return_counts=True)
    if told is not None:
        pair, c_pair = np.append(pair, told.pair), np.append(c_pair, told.count)
        order = np.argsort(pair)
        pair, c_pair = pair[order], c_pair[order]
    word, at = np.unique(pair // n, return_index=True)
    kinds = np.diff(np.append(at, len(pair)))
    c_word = np.add.reduceat(c_pair, at) if len(at) else np.zeros(0, np.int64)
    t = np.where(spread[word], told.kinds[word], kinds) if told is not None else kinds
    c_word = np.where(spread[word], told.total[word], c_word) if told is not None else c_word
    of = np.repeat(np.arange(len(word)), kinds)
    p_pair = (c_pair + t[of] * p[pair % n]) / (c_word[of] + t[of])

    deep = left > 0
    context, which = np.unique(m[deep] * n + left[deep], return_inverse=True)
    triple, c_triple = np.unique(which * n + right[deep], return_counts=True)
    owner, follows = np.divmod(triple, n)
    c_context, kinds2 = np.bincount(owner, c_triple, len(context)), np.bincount(owner, minlength=len(context))
    shorter = p_pair[np.searchsorted(pair, (context // n)[owner] * n + follows)] if len(triple) else np.zeros(0)
    p_triple = (c_triple + kinds2[owner] * shorter) / (c_context[owner] + kinds2[owner])

    # Both kinds of contexts in one level, by word, then by the word before; none comes first.
    nodes = np.concatenate([word * n, context])
    order = np.argsort(nodes, kind="stable")
    sizes = np.concatenate([kinds, kinds2])[order]
    first = np.concatenate([at, len(pair) + np.cumsum(kinds2) - kinds2])[order]
    take = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    contexts = np.searchsorted(nodes[order] // n, np.append(word, n))
    with np.errstate(divide="ignore"):
        leaves = np.log10(np.concatenate([t / (c_word + t), kinds2 / (c_context + kinds2)]))[order]
        values = np.log10(np.concatenate([p_pair, p_triple]))[take]
    return Trie.build(word, contexts, nodes[order] % n, np.append(0, np.cumsum(sizes)), np.concatenate([pair % n, follows])[take], leaves, values)


def ask(trie: Trie, m: np.ndarray, left: np.ndarray, of: np.ndarray, right: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the probability of the words ``right`` behind the contexts (left, m) with numbers ``of``; left may be 0."""
    known, out = trie.follow(trie.context(m, left)[of], right)
    again = np.flatnonzero(~known & (left[of] > 0))
    if len(again):
        known[again], more = trie.follow(trie.context(m, np.zeros(len(m), np.int64))[of[again]], right[again])
        out[again] += more
    return np.where(known, out, out + np.log10(p[right]))


def _told(it: Corpus, names: np.ndarray, spread: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> Spread | None:
    """Of the shard's ``pairs`` (word, number of the next one, count), in order, those of the spread words among ``names``."""
    if it.spread is None or not spread.any():
        return None
    hashes, totals, kinds = it.spread
    of = np.searchsorted(names, hashes)
    here = np.flatnonzero(names[np.minimum(of, len(names) - 1)] == hashes)
    total, different = np.zeros((2, len(names)), np.int64)
    total[of[here]], different[of[here]] = totals[here], kinds[here]
    word, follows, count = pairs
    m = np.minimum(np.searchsorted(names, word), len(names) - 1)
    mine = names[m] == word
    # No word, which nothing asks for, is told too: a spread word without a pair here still leaves its weight.
    code = np.concatenate([of[here] * n, m[mine] * n + follows[mine]])
    count = np.concatenate([np.zeros(len(here), np.int64), count[mine]])
    order = np.argsort(code)
    return Spread(code[order], count[order], total, different)


def _part_scores(it: Corpus, pieces: list[Piece], p: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[Piece, np.ndarray, np.ndarray, np.ndarray]]:
    """Each piece's positions: whether training has the middle word, its base logarithm, and the next word's by the model; ``p`` is that of neighbours.

    A document's first word has no context: its base logarithm goes with the next word's.
    """
    names = np.unique(np.concatenate([x.names for x in pieces]))
    # Four bytes a number as long as it is one of many positions.
    m = np.concatenate([np.repeat(np.searchsorted(names, x.names).astype(np.int32), x.counts) for x in pieces])
    left, right = (np.concatenate(c) for c in ([x.left for x in pieces], [x.right for x in pieces]))
    train = np.concatenate([x.doc & 1 for x in pieces]) == 1
    count, n = it.count(names), len(p)
    spread = count > it.most
    total = np.where(count >= 0, count, np.bincount(m[train], minlength=len(names)))
    trie = build_trie(m[train], left[train], right[train], _told(it, names, spread, pairs, n), p, spread)
    # Equal positions are asked once.
    contexts, which = np.unique(m.astype(np.int64) * n + left, return_inverse=True)
    triple, back = np.unique(which * n + right, return_inverse=True)
    del which, left, right
    c, r = np.divmod(triple, n)
    real = np.flatnonzero(r > 0)
    logs = np.zeros(len(triple))
    for at in range(0, len(real), 1 << 18):
        part = real[at : at + (1 << 18)]
        mine, of = np.unique(c[part], return_inverse=True)
        logs[part] = ask(trie, contexts[mine] // n, contexts[mine] % n, of, r[part], p)
    base = np.log10((total + 1) / (it.tokens + it.distinct + 1))
    begin = 0
    for x in pieces:
        s = slice(begin, begin + len(x.doc))
        yield x, (total > 0)[m[s]], base[m[s]], logs[back[s]] + np.where(x.left == 0, base[m[s]], 0.0)
        begin = s.stop


def _scorer(known: Broadcast, parts: int):
    """All pieces of a shard to sums by document, one row a batch; a part of the shard's words at a time."""

    def score(table: pa.Table, told: pa.Table | None) -> pa.Table:
        it: Corpus = known.value
        press = zstandard.ZstdCompressor(1)
        batches, data, raw, others = [], [], [], []
        for value in table.column("data"):
            buffer = value.as_buffer()
            kind = np.frombuffer(buffer, np.int64, 1)[0]
            if kind == -1:
                batches.append(int(np.frombuffer(buffer, np.int64, 2)[1]))
                data.append(buffer.to_pybytes())
            elif kind == -2:
                others.append(buffer.to_pybytes())
            else:
                raw.append(Piece.open(buffer.to_pybytes()))
        near = np.unique(np.concatenate([np.full(1, NONE, np.uint64), *(x.near for x in raw)]))
        p, raw = it.p(near, _other_counts(others)), [x.renumbered(near) for x in raw]
        del others
        none = np.zeros(0, np.int64)
        word, follows, count = (told.column(c).to_numpy() for c in ("word", "next", "c")) if told is not None else (none, none, none)
        pairs = word.view(np.uint64), np.searchsorted(near, follows.view(np.uint64)), count
        del near
        sums: dict[int, np.ndarray] = {}
        for part in range(parts):
            pieces = [x for x in (piece.part(part, parts) for piece in raw) if len(x.doc)]
            for x, *values in _part_scores(it, pieces, p, pairs) if pieces else ():
                mine = sums.setdefault(x.batch, np.zeros((3, x.docs)))
                for k, v in enumerate(values):
                    mine[k] += np.bincount(x.doc >> 1, v, x.docs)
        for batch, found in sums.items():
            seen = np.flatnonzero(found[1])
            head = np.array([0, len(seen)], np.int64).tobytes()
            batches.append(batch)
            data.append(head + press.compress(_planes(np.diff(seen, prepend=0)) + _planes(found[0][seen]) + found[1:, seen].tobytes()))
        return pa.Table.from_arrays([pa.array(batches, pa.int64()), pa.array(data, pa.binary())], schema=PARTIAL)

    return score


def _gathered(table: pa.Table) -> pa.Table:
    """Sums of all shards for the documents of one batch."""
    rows = table.column("data").to_pylist()
    (info,) = (x for x in rows if np.frombuffer(x, np.int64, 1)[0] == -1)
    _, _, n = np.frombuffer(info, np.int64, 3).tolist()
    ids = np.frombuffer(info, np.int64, n, 24)
    is_known, held = (np.frombuffer(info, bool, n, 24 + (8 + k) * n) for k in (0, 1))
    tokens = np.frombuffer(info[24 + 10 * n :], np.int64)
    sums = np.zeros((3, n))
    for x in rows:
        kind, k = np.frombuffer(x, np.int64, 2).tolist()
        if kind == 0:
            r = _Reader(x[16:])
            seen = np.cumsum(r.planes(k), dtype=np.int64)
            sums[0, seen] += r.planes(k)
            sums[1:, seen] += r.plain("<f8", 2 * k).reshape(2, k)
    columns = [pa.array(ids, mask=~is_known), pa.array(held), pa.array(tokens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
    return pa.Table.from_arrays(columns, schema=SCORES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT, most: int = MOST, shard: int = SHARD, parts: int = PARTS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between white space, A-Z lower-cased, and one end.  ``held_out`` is an SQL condition on doc_id that
    rows must not meet to be learnt from.  ``base_score`` sums log10((c + 1) / (N + V + 1)) over tokens with counts c; ``score`` is the
    model's, of contexts of up to two words.  ``n_known`` counts tokens that training has.

    Null texts are the end alone; identifiers may be null, which are learnt from, or repeated, rows are scored each for
    itself; texts of any length are read whole; an empty table gives no rows; other columns are ignored.  Without
    any training row N and V are 0 and every token has probability 1.
    """
    rows = _documents(docs, id_col, text_col, held_out)
    found = corpus(rows, most, shard)
    known = docs.sparkSession.sparkContext.broadcast(found)
    pieces = rows.mapInArrow(_sender(known), PIECES)
    if found.rest:
        asked = rows.mapInArrow(_asker(known, -(-found.rest // shard)), "owner int, data binary")
        pieces = pieces.unionByName(asked.groupBy("owner").applyInArrow(_answered, PIECES))
    if (found.counts > found.most).any():
        told, stats = _spread_pairs(rows, known)
        score = _scorer(docs.sparkSession.sparkContext.broadcast(replace(found, spread=stats)), parts)
        sums = pieces.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(score, "batch long, data binary")
    else:
        score = _scorer(known, parts)
        sums = pieces.groupBy("shard").applyInArrow(lambda table: score(table, None), "batch long, data binary")
    scores = sums.groupBy("batch").applyInArrow(_gathered, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score")
