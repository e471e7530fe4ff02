"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits are linked.  Equal fingerprints
are one class from the start, so copies cost one node however many there are.

Sharding: cut 64 bits into four blocks; fingerprints within three bits agree on one
block, and, of the 48 bits left, on one of four blocks again.  So each class goes to 16
shards, keyed by 28 bits on which all of a shard agree, and no link is lost.  Shards
over ``most_in_shard`` classes are split by the same rule over the bits they have left.

Inside a shard the fingerprints lie in Gray order, in which neighbours share most of
their bits.  Runs of eight are factored into a node that holds the bits on which they
all agree, with the rest masked; nodes are factored alike up to a root.  Two subtrees are
compared by the differences of their agreed bits, which only grow on the way down: as soon as they
exceed the radius, the whole pair of groups is pruned.  Within a shard the links are
reduced to a forest at once, so a dense group never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import Out, held, pick, rows_of, text_of, without, written
from quorumscan.llm.components import connected_components

SEED, FANOUT = 42, 8
#: Pairs of nodes that are expanded at once; bounds the memory of a search.
FRONTIER = 1 << 18
PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("print", pa.int64()), ("n_words", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, width: int = 3) -> tuple[int, int]:
    """(fingerprint, number of words) of a text; only A-Z are lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0, 0
    data = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        spans = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]), len(words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash (which tells rows of one identifier apart), print (the 64 bits as a long) and n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", lambda: True)
        for batch in batches:
            out = Out(PRINTS)
            for doc_id, text_hash, text in rows_of(batch, "doc_id", "text_hash", "text"):
                bits, n = fingerprint(text, width)
                out.add(doc_id, text_hash, bits - (bits >> 63 << 64), n)
            if len(out):
                yield out.take()

    rows = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, print long, n_words long")


def _split(df: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """Each row into one shard per block of its ``rest`` (``bits`` wide): those within three bits share one."""
    size = -(-bits // 4)
    cuts = [(min(k * size, bits), min((k + 1) * size, bits)) for k in range(4)]
    shards = []
    for k, (lo, hi) in enumerate(cuts):
        block = f"shiftrightunsigned(rest, {lo}) & {(1 << (hi - lo)) - 1}L" if hi > lo else "0L"
        above = f"shiftleft(shiftrightunsigned(rest, {hi}), {lo})" if hi < bits else "0L"
        shards.append(f"struct(xxhash64(shard, {k}, {block}) AS shard, {above} | (rest & {(1 << lo) - 1}L) AS rest)")
    out = df.select("print", F.explode(F.array(*map(F.expr, shards))).alias("s")).select("print", "s.shard", "s.rest")
    return out, bits - size


def shards_of(prints: DataFrame, most_in_shard: int) -> DataFrame:
    """(print, shard) such that any two prints within three bits share a shard."""
    rows = prints.select("print", F.lit(0).cast("long").alias("shard"), F.col("print").alias("rest"))
    rows, bits = _split(rows, 64)
    rows, bits = _split(rows, bits)
    done = None
    while bits > 4:
        large = written(rows.groupBy("shard").count().filter(F.col("count") > most_in_shard).select("shard"), "large-shards")
        if large.isEmpty():
            break
        fine = rows.join(large, "shard", "left_anti").select("print", "shard")
        done = fine if done is None else done.union(fine)
        rows, bits = _split(rows.join(large, "shard", "left_semi"), bits)
    rows = rows.select("print", "shard")
    return rows if done is None else done.union(rows)


def gray_rank(bits: str) -> Column:
    """The place of 64 bits, read as a Gray code, in its order (of signed longs)."""
    rank = F.col(bits)
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank


class Forest:
    """Union-find over 0..n-1, joined by arrays of pairs; the root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while (p != p[p]).any():
                p[:] = p[p]


def linked(shard: np.ndarray, prints: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within shards; rows lie by shard, then in Gray order."""
    n = len(shard)
    group = np.cumsum(np.r_[0, shard[1:] != shard[:-1]])
    ones, zeros = [prints], [~prints]
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        at = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        if not at.any():
            break
        starts = np.flatnonzero(at % FANOUT == 0)
        spans.append((starts, np.diff(np.r_[starts, len(group)])))
        ones.append(np.bitwise_and.reduceat(ones[-1], starts))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], starts))
        group = group[starts]
    forest = Forest(n)
    roots = np.arange(len(group))
    stack = [(len(spans), roots[k : k + FRONTIER], roots[k : k + FRONTIER]) for k in range(0, len(roots), FRONTIER)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            forest.join(a, b)
            continue
        starts, counts = spans[level - 1]
        each = counts[a] * counts[b]
        if len(a) > 1 and each.sum() > FRONTIER * FANOUT:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        of = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        wide = counts[b][of]
        x, y = starts[a][of] + k // wide, starts[b][of] + k % wide
        below = x < y if level == 1 else x <= y
        keep = np.flatnonzero(below | (a != b)[of])
        x, y = x[keep], y[keep]
        o, z = ones[level - 1], zeros[level - 1]
        near = np.bitwise_count((o[x] & z[y]) | (z[x] & o[y])) <= radius
        if near.any():
            stack.append((level - 1, x[near], y[near]))
    root = forest.parent
    inner = np.flatnonzero(root != np.arange(n))
    return prints[inner], prints[root[inner]]


def links(prints: DataFrame, radius: int = 3, most_in_shard: int = 200_000, block_rows: int = 1 << 16) -> DataFrame:
    """Edges (a, b) between distinct prints that connect all prints within ``radius`` (3 at most) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards hold links of up to three bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def searched(shard: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(shard) > 1:
                same = np.r_[False, shard[1:] == shard[:-1]]
                shared = same | np.r_[same[1:], False]
                if shared.any():
                    a, b = linked(shard[shared], prints[shared], radius)
                    for at in range(0, len(a), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (a, b)], schema=EDGES)

        for batch in batches:
            held.append((batch.column("shard").to_numpy(), batch.column("print").to_numpy().view(np.uint64)))
            if sum(len(s) for s, _ in held) >= block_rows:
                shard, prints = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero(shard != shard[-1])[-1] + 1) if shard[0] != shard[-1] else 0  # the last shard may go on
                held = [(shard[cut:], prints[cut:])]
                yield from searched(shard[:cut], prints[:cut])
        if held:
            yield from searched(*(np.concatenate(x) for x in zip(*held)))

    rows = shards_of(prints.select("print"), most_in_shard)
    ranked = rows.repartition("shard").select("shard", "print", gray_rank("print").alias("rank"))
    return ranked.sortWithinPartitions("shard", "rank").select("shard", "print").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, most_in_shard: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_words, text_hash.

    ``component_id`` is the smallest identifier that links reach from the row, its own
    included.  Null texts and texts without a word have fingerprint zero, which links like
    any other.  Texts of fewer than ``width`` words are one shingle.  Rows with a null
    identifier take part in links but never name a component; it is null where no member has
    an identifier.  An empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-classes")
    members = connected_components(links(classes, radius, most_in_shard))
    classed = classes.join(members, classes["print"] == members["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    return (
        prints.join(classed.join(named, "component").select("print", "component_id"), "print")
        .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_words", "text_hash")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that name their component (see ``near_duplicates``).

    Rows that repeat an identifier and a text stay or go together; of rows with a null
    identifier only those stay whose whole component has none.
    """
    verdict = near_duplicates(docs, id_col, text_col, **how)
    gone = verdict.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    return without(docs, id_col, F.xxhash64(text_of(text_col)), written(gone, "near-gone"))
