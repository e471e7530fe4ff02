"""Fuzzy line dedup by MinHash: of each group of near-equal lines one stays.

Main path: DataFrame and SQL functions only.

1. Equal lines become one row with their earliest place and their number.
2. Shingles are the ``width`` characters from every character on that has as many; a shorter
   line is its own shingle.  They are cut from four bytes a character, exploded, and go through one
   hash aggregation that needs no exchange, as the rows lie by line already.  Each of the ``bands``
   bands has a hash function of its own, and the band's four rows are the least shingles by that hash
   with its two upper bits flipped in each of the four ways: four parts of one permutation, where
   an empty part borrows from its neighbour.
3. Lines that share a band are candidates.  Bands that only one line has are told apart by a count
   of their hashes; the rest are few.
4. Candidates are verified by exact Jaccard similarity of their shingle sets: each line first against
   a few hubs of its band, lines that are chosen by hash, which joins a band of like lines at a cost of
   some comparisons a line.  In bands that this leaves in several components, lines of different
   components meet in blocks of bounded size.  Their shingles' bitmaps there rule out every pair that
   differs in more bits than pairs that are similar enough can, so none is lost; pairs that pass are verified.
   The bitmaps are made once for all candidates, and pairs with hubs are held against them first, too.
5. Distributed union-find over the links; a component keeps its earliest line.

Equal lines, however many, are pre-aggregated in each task; joins by line carry places, and the
texts of candidates where they are verified, and leave hot lines to the adaptive skew join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import mark_members, text_of, written
from quorumscan.llm.components import connected_components

#: Identifier that stands for null in the order of documents: it comes last.
LAST = (1 << 63) - 1
#: A line without a word is never touched.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Rows of a band: the ways to flip the two upper bits of a hash.
FLIPS = [0, 1 << 62, -(1 << 63), -(1 << 62)]
#: Words of 64 bits in the bitmap of a line's shingles.
WORDS = 32


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return ordered.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def _lines(documents: DataFrame) -> DataFrame:
    """doc, row, pos, line, key of every line with a word; the key is 16 bytes of its SHA-256."""
    exploded = documents.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return exploded.filter(F.col("line").rlike(HAS_WORD)).withColumn("key", F.substring(F.unhex(F.sha2("line", 256)), 1, 16))


def _starts(line: str, width: int) -> Column:
    """Where the shingles of a line begin, from 0."""
    return F.sequence(F.lit(0), F.greatest(F.length(line) - width, F.lit(0)))


def _shingle(wide: Column, start: Column, width: int) -> Column:
    """64-bit hash of the shingle from a character on; ``wide`` is the line in four bytes a character."""
    return F.xxhash64(F.substring(wide, start * 4 + 1, F.lit(4 * width)))


def shingles(line: str, width: int) -> Column:
    """Hashes of the ``width`` characters from every character on that has as many; a shorter line whole."""
    hashes = F.transform(F.array(F.encode(line, "UTF-32")), lambda w: F.transform(_starts(line, width), lambda k: _shingle(w, k, width)))
    return F.array_distinct(F.get(hashes, F.lit(0)))


def exploded(lines: DataFrame, width: int, step: int, *columns: str) -> DataFrame:
    """``columns`` and h0, h1, ...: a row for every ``step`` shingles of the column line, the last repeated where there are less."""
    last = F.greatest(F.length("line") - width, F.lit(0))
    wide = lines.select(*columns, F.encode("line", "UTF-32").alias("_wide"), last.alias("_last"), F.sequence(F.lit(0), last, F.lit(step)).alias("_starts"))
    wide = wide.select(*columns, "_wide", "_last", F.explode("_starts").alias("_start"))  # apart, or each row would encode its line
    return wide.select(*columns, *(_shingle(F.col("_wide"), F.least(F.col("_start") + j, F.col("_last")), width).alias(f"h{j}") for j in range(step)))


def signatures(distinct: DataFrame, width: int, bands: int, step: int = 2) -> DataFrame:
    """key, at, n and the hashes of the bands of every distinct line; minima are taken over ``step`` shingles first."""
    places = [F.col("at.doc").alias("d"), F.col("at.row").alias("r"), F.col("at.pos").alias("p")]
    names = ("key", "n", "d", "r", "p")
    every = exploded(distinct.select("key", "n", "line", *places), width, step, *names)
    every = every.select(*names, *(F.xxhash64(f"h{j}", F.lit(b)).alias(f"h{b}_{j}") for b in range(bands) for j in range(step)))
    every = every.select(*names, *(F.least(*(F.col(f"h{b}_{j}").bitwiseXOR(F.lit(flip)) for j in range(step))).alias(f"m{b}_{k}") for b in range(bands) for k, flip in enumerate(FLIPS)))
    minima = [F.min(f"m{b}_{k}").alias(f"m{b}_{k}") for b in range(bands) for k in range(len(FLIPS))]
    least = every.groupBy("key").agg(*(F.min(c).alias(c) for c in ("n", "d", "r", "p")), *minima)
    hashes = F.array(*(F.xxhash64(F.lit(b), *(f"m{b}_{k}" for k in range(len(FLIPS)))) for b in range(bands)))
    return least.select("key", F.struct(F.col("d").alias("doc"), F.col("r").alias("row"), F.col("p").alias("pos")).alias("at"), "n", hashes.alias("bands"))


def _sizes_fit(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - F.lit(1e-9)


def _bits_fit(x: str, y: str, x_size: str, y_size: str, similarity: float) -> Column:
    """False only where bitmaps, with columns of these prefixes, differ in more bits than those of sets that are similar enough can.

    Two lines differ in a shingle at least for each bit in which their bitmaps differ, and similar ones
    in (1 - similarity) / (1 + similarity) of the sum of their sizes at most.
    """
    differing = reduce(Column.__add__, (F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in range(WORDS)))
    return differing <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(x_size) + F.col(y_size)) + F.lit(1e-9)


def _links(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets are similar enough."""

    def side(key: str, line: str, size: str) -> DataFrame:
        return texts.select(F.col("key").alias(key), F.col("line").alias(line), F.col("size").alias(size), *(F.col(f"w{w}").alias(f"{key}_w{w}") for w in range(WORDS)))

    joined = pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")
    joined = joined.filter(_sizes_fit("m", "n", similarity)).filter(_bits_fit("a_w", "b_w", "m", "n", similarity))
    both = F.size(F.array_intersect(shingles("x", width), shingles("y", width)))
    return joined.filter(both * (1 + similarity) >= similarity * (F.col("m") + F.col("n")) - 1e-9).select("a", "b")


def _hub_pairs(members: DataFrame, hubs: int) -> DataFrame:
    """Each line with up to ``hubs`` lines of its band, chosen by hash."""
    picks = members.groupBy("band").agg(F.array_distinct(F.array(*(F.min_by("key", F.xxhash64("key", F.lit(k))) for k in range(hubs)))).alias("picks"))
    pairs = members.join(picks, "band").select("key", F.explode("picks").alias("hub")).filter("key != hub")
    return pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """key and the words w0, w1, ... of a bitmap in which every shingle of the line sets one bit."""
    every = exploded(texts.repartition("key"), width, 1, "key").select("key", F.pmod("h0", F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(h0, 32), 64) AS int))").alias("bit"))
    every = every.groupBy("key", "word").agg(F.bit_or("bit").alias("bit"))  # a column for each word only where there is a row for each word
    return every.groupBy("key").agg(*(F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)))


def _block_pairs(members: DataFrame, groups: DataFrame, marked: DataFrame, texts: DataFrame, similarity: float, n_bands: int, block: int) -> DataFrame:
    """Pairs (a, b) of lines of different components that share a band and that the bitmaps do not rule out.

    The lines of a band are dealt out in blocks of about ``block`` lines, and each block meets all of the band in a task of its own.
    A pair is made in the first band that it shares.
    """
    placed = members.join(groups, members["key"] == groups["node"], "left").select("band", "key", F.coalesce("component", "key").alias("group"))
    bands = placed.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = written(placed.join(bands.filter("lo != hi").drop("lo", "hi"), "band"), "open-bands")
    hashes = mark_members(marked.select("key", "bands"), placed, "key").filter("_member").drop("_member")
    rows = written(placed.join(hashes, "key").join(texts.drop("line"), "key"), "open-lines")

    def side(x: str, block_of: Column) -> DataFrame:
        names = ("key", "group", "size", "bands", *(f"w{w}" for w in range(WORDS)))
        return rows.select("band", block_of.alias("block"), *(F.col(c).alias(f"{x}_{c}") for c in names))

    left = side("a", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = _bits_fit("a_w", "b_w", "a_size", "b_size", similarity)
    first = F.coalesce(*(F.when(F.get("a_bands", F.lit(b)) == F.get("b_bands", F.lit(b)), F.get("a_bands", F.lit(b))) for b in range(n_bands)))
    meet = (left["band"] == right["band"]) & (left["block"] == right["block"]) & (F.col("a_key") < F.col("b_key")) & (F.col("a_group") != F.col("b_group"))
    return left.join(right, meet & _sizes_fit("a_size", "b_size", similarity) & near & (first == left["band"])).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def line_components(lines: DataFrame, marked: DataFrame, width: int, similarity: float, n_bands: int, hubs: int = 4, block: int = 512) -> DataFrame:
    """(node, component) of the lines that are linked; ``marked`` is the signatures of all lines, of ``n_bands`` bands."""
    banded = marked.select("key", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").count().filter("count > 1").select("band"), "shared-bands")
    members = mark_members(banded, shared, "band").filter("_member").select("key", "band")
    members = written(members.join(shared, "band"), "band-members")
    keys = members.select("key").distinct()
    texts = mark_members(lines.select("key", "line"), members, "key").filter("_member").select("key", "line")
    texts = texts.groupBy("key").agg(F.first("line").alias("line")).join(keys, "key", "left_semi")
    texts = written(texts.withColumn("size", F.size(shingles("line", width))), "candidate-texts")
    texts = written(texts.join(bitmaps(texts, width), "key"), "candidate-lines")

    groups = connected_components(_links(_hub_pairs(members, hubs), texts, width, similarity))
    found = written(_links(_block_pairs(members, groups, marked, texts, similarity, n_bands, block), texts, width, similarity), "more-links")
    if found.isEmpty():
        return groups
    return connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, similarity: float = 0.8, bands: int = 9, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_sha256, and kept_text if ``with_text``.

    Lines end at ``\\n``.  Lines are linked at a Jaccard similarity of ``similarity`` or more
    of their shingle sets; equal lines always are.  Of a component the line of the smallest
    identifier, then place, stays.  Lines without a word are left alone and not counted
    in n_lines.  Null texts have no lines.  Lines of any length are compared whole.  Rows with a null
    identifier come after all others; rows of one identifier are ordered by a hash of their texts, and rows
    that repeat identifier and text are one document whose result each of them gets.  An empty table
    gives no rows; other columns are ignored.

    A pair at the similarity shares a band with probability 1 - (1 - similarity ** 4) ** bands
    (0.991 by default, 0.9999 at 0.9); every pair that does is verified, on 64-bit hashes of the shingles.
    """
    documents = _documents(docs, id_col, text_col)
    lines = _lines(documents)
    place = F.struct("doc", "row", "pos")
    distinct = lines.groupBy("key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    marked = written(signatures(distinct, width, bands), "line-signatures")
    groups = line_components(lines, marked, width, similarity, bands)

    linked = written(groups.select(F.col("node").alias("key"), "component"), "linked-lines")
    known = mark_members(marked.select("key", "at", "n"), linked, "key").filter("_member or n > 1").join(linked, "key", "left")
    named = known.filter("component is not null").groupBy("component").agg(F.min("at").alias("keep"))
    grouped = known.join(named, "component").select("key", "keep")
    alone = known.filter("component is null and n > 1").select("key", F.col("at").alias("keep"))
    repeated = written(grouped.unionByName(alone), "repeated-lines")

    found = mark_members(lines.select("doc", "row", "pos", "key"), repeated, "key").filter("_member")
    gone = found.join(repeated, "key").filter(place != F.col("keep"))
    gone = written(gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "lines-gone")

    split = mark_members(documents, gone, "doc")
    hit = split.filter("_member").join(gone, ["doc", "row"], "left").select("doc_id", "text", "gone")
    free = split.filter("not _member").select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    out = hit.unionByName(free).withColumn("parts", F.split("text", "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(rest, lambda k: F.get("parts", k)), "\n")
    out = out.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    n = F.size(F.filter("parts", lambda x: x.rlike(HAS_WORD))).cast("long")
    columns = ["doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")]
    return out.select(*columns, *(["kept_text"] if with_text else []))
