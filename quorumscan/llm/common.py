"""Helpers shared by the operators: the shared folder, written tables, Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow slice turns into Python objects at a time.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset in a local
    session, as in tests, a folder of this machine is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quorumscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quorumscan/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than a new read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Least and largest number of bits of the broadcast bitmap of ``mark_members``: 128 kB to 16 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Bits of the bitmap for each member, as far as the largest number allows.
BITS_A_MEMBER = 16
#: Bits that one row of the bitmap holds; a fixed value of Spark's bitmap functions.
BUCKET_BITS = 32768


def filter_bits(members: int) -> int:
    """A power of two, by the number of members."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_MEMBER * members).bit_length()))


def mark_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``rows`` with a boolean ``_member``: true wherever ``key`` is in ``members``.

    A bitmap is broadcast, so nothing is shuffled; it is sized by the number of members, at most 16 MB.
    It is true for few other rows (one in 16 to 32 up to 8 million members), and for more as it fills, when callers
    shuffle more rows than they need to; never false for a member.  ``members`` is read twice, so it should be a written table.
    """
    bits = filter_bits(members.count())
    bit = F.pmod(F.xxhash64(key), F.lit(bits))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", (bit / BUCKET_BITS).cast("int")).withColumn("_at", (bit % BUCKET_BITS).cast("int"))

    bitmap = placed(members.select(key)).groupBy("_bucket").agg(F.bitmap_construct_agg(F.col("_at").cast("long")).alias("_bits"))
    # As 64-bit words, the first byte on top: a look at an array's element costs much less than one at a byte.
    bitmap = bitmap.select("_bucket", F.expr(f"transform(sequence(0, {BUCKET_BITS // 64 - 1}), i -> cast(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) as long))").alias("_bits"))
    is_set = "(shiftright(get(_bits, cast(_at div 64 as int)), cast((7 - (_at div 8) % 8) * 8 + _at % 8 as int)) & 1L) != 0"
    asked = placed(rows).join(F.broadcast(bitmap), "_bucket", "left")
    return asked.withColumn("_member", F.coalesce(F.expr(is_set), F.lit(False))).drop("_bucket", "_at", "_bits")


def without(docs: DataFrame, id_col: str, hashed: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose identifier and hash are not in ``gone`` (_gone_id, _gone_hash), a written table.

    Only rows whose hash a bitmap of the gone ones lets through are shuffled.
    """
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    asked = mark_members(docs.select(whole, F.col(f"`{id_col}`").alias("id"), hashed.alias("_gone_hash")), gone, "_gone_hash")
    hit = asked.filter("_member").alias("h").join(gone.alias("g"), F.expr("h.id <=> g._gone_id AND h._gone_hash = g._gone_hash"), "left_anti")
    kept = asked.filter("not _member").select("row").unionByName(hit.select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in names))


def text_of(text: str | Column) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` of any table, whatever else it carries."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


#: What the operator at work keeps in this Python worker.
_held: dict[object, object] = {}


def held[T](key: object, make: Callable[[], T]) -> T:
    """``make()``, kept in this Python worker for later tasks that ask for the same key.

    A worker goes on from one operator's tasks to another's: what was kept under other keys goes first.
    """
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def groups_of(batch: pa.RecordBatch, *names: str, most_bytes: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows of a batch as tuples, in groups of bounded number and size; the last name is the text column."""
    columns = [batch.column(n) for n in names]
    for at in range(0, batch.num_rows, SLICE_ROWS):
        group: list[tuple] = []
        held = 0
        for row in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in columns), strict=True):
            group.append(row)
            held += len(row[-1])
            if held >= most_bytes:
                yield group
                group, held = [], 0
        if group:
            yield group


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch as tuples, a bounded slice at a time."""
    for group in groups_of(batch, *names):
        yield from group


class Out:
    """Collects result rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 5000) -> None:
        self.schema, self.rows = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def __len__(self) -> int:
        return len(self.columns[0])

    def full(self) -> bool:
        return len(self) >= self.rows

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
