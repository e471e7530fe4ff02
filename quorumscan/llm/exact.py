"""Exact duplicate removal by a log-structured merge index of digests.

Main path: DataFrame functions only.

* Memtables: rows come in batches; every task digests its rows, sorts them by digest and
  flushes them as one run.
* Compaction merges the runs since the last one into the level before, one entry per digest with the
  smallest (and largest) identifier and the number of rows.  The runs' digests make a filter, a bitmap:
  entries of the level that it rules out are carried over as they are, the others are merged.
* Hits, digests with more than one row, are verified on the bytes of the texts: the
  smallest and the largest text of a digest must be the same text.  A bitmap of
  hit digests of fixed size is broadcast so that only (nearly) hits are shuffled
  with their texts; when it fills up it lets more through, never less.
* Digests that fail (different texts, one digest) are regrouped by the text itself.

Skew: all grouping is pre-aggregated in each task, so a text that makes up a third
of all rows costs one row per task.  The join of runs with entries carries
identifiers and digests only; its hot digests are left to the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumscan.llm.common import mark_members, pick, scratch_path, text_of, without, written

RUN = "digest binary, sha binary, id long"
MERGED = "digest binary, least_id long, largest_id long, n long"


class DigestIndex:
    """Sorted runs of (digest, sha, id) under ``path`` and their levels.

    ``flush`` is called once per arriving batch; ``compact`` merges the runs that came since it was
    called last into the level before.  Old levels stay until the folder goes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.runs, self.merged, self.levels = spark, path, 0, 0, 0

    def _write(self, df: DataFrame, to: str) -> None:
        df.sortWithinPartitions("digest").write.parquet(f"{self.path}/{to}")

    def flush(self, rows: DataFrame) -> None:
        """Write a batch (digest, sha, id): each task's rows become a sorted run; nothing is shuffled."""
        self.runs += 1
        self._write(rows.select("digest", "sha", F.col("id").cast("long")), f"runs/batch={self.runs}")

    def _runs(self, first: int) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/runs/batch={k}" for k in range(first, self.runs + 1)))

    def rows(self) -> DataFrame:
        return self._runs(1)

    def entries(self) -> DataFrame:
        """One entry per digest of the runs that are compacted."""
        return self.spark.read.schema(MERGED).parquet(f"{self.path}/level={self.levels}")

    def compact(self) -> DataFrame:
        """One entry per digest: the smallest and largest id and the number of rows."""
        if self.merged < self.runs:
            ids = [F.min("id").alias("least_id"), F.max("id").alias("largest_id"), F.count(F.lit(1)).alias("n")]
            fresh = self._runs(self.merged + 1).groupBy("digest").agg(*ids)
            self.levels, self.merged = self.levels + 1, self.runs
            if self.levels == 1:
                self._write(fresh, "level=1")
            else:
                self._write(fresh, f"fresh={self.levels}")
                fresh = self.spark.read.schema(MERGED).parquet(f"{self.path}/fresh={self.levels}")
                before = self.spark.read.schema(MERGED).parquet(f"{self.path}/level={self.levels - 1}")
                asked = mark_members(before, fresh, "digest")
                both = asked.filter("_member").drop("_member").unionByName(fresh)
                met = both.groupBy("digest").agg(F.min("least_id").alias("least_id"), F.max("largest_id").alias("largest_id"), F.sum("n").alias("n"))
                self._write(asked.filter("not _member").drop("_member").unionByName(met), f"level={self.levels}")
        return self.entries()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "least", digest_bytes: int = 16, batches: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same string; a null text is the empty text.
    ``keep`` names the identifier that stays: ``least`` or ``largest``.  The index holds
    ``digest_bytes`` of the SHA-256 and takes the rows in ``batches``, dealt by a hash.  Texts of any length are
    compared whole.  Rows with a null identifier are counted; they stay
    only where all of their group are null (keep_id is null then).  Rows that repeat an
    identifier and a text stay or go together.  An empty table gives no rows.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    sha = F.unhex(F.sha2("text", 256))
    rows = pick(docs, id_col, text_col).withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, digest_bytes))
    index = DigestIndex(spark, scratch_path(spark, "digests"))
    for k in range(batches):
        index.flush(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k).withColumnRenamed("doc_id", "id"))
        index.compact()
    hits = index.entries().filter("n > 1").select("digest", F.col(f"{keep}_id").alias("keep_id"), F.col("n").alias("group_size"))

    # The bytes of all texts of a digest are the same if the smallest is the largest.
    texts = mark_members(rows.select("digest", "text"), hits, "digest").filter("_member")
    spread = texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    collided = written(spread.filter("lo != hi").select("digest"), "collided")

    found = index.rows().withColumnRenamed("id", "doc_id")
    clean = found if collided.isEmpty() else found.join(collided, "digest", "left_anti")
    out = clean.join(hits, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "sha",
    )
    if not collided.isEmpty():
        again = rows.join(collided, "digest", "left_semi").select("doc_id", "text", "sha")
        best = F.min("doc_id") if keep == "least" else F.max("doc_id")
        groups = again.groupBy("text").agg(best.cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(again.join(groups, "text").select("doc_id", "keep_id", "group_size", "sha"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "least") -> DataFrame:
    """The rows of ``docs``, all columns, whose identifier stays (see ``exact_duplicates``).

    Repeats of an identifier with the same text stay together; rows with a null
    identifier stay where their group has no other.
    """
    verdict = exact_duplicates(docs, id_col, text_col, keep)
    gone = verdict.filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.unhex("text_sha256").alias("_gone_hash")).distinct()
    return without(docs, id_col, F.unhex(F.sha2(text_of(text_col), 256)), written(gone, "exact-gone"))
