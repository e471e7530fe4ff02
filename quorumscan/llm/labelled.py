"""Bounded samples of labelled documents, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", train: str | None = None, most_chars: int = 1 << 16) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) of label 0 and of label 1, whole texts of at most ``most_chars`` characters.

    What comes to the driver is so bounded by ``2 * per_class * most_chars`` characters.  An identifier gives one text, of
    several the one with the smallest hash; one whose text is longer gives none.

    The identifiers with the smallest hashes are taken, so the sample does not depend on
    the order or partitioning of the tables.  Null labels and identifiers are left out, of
    several labels of an identifier the largest counts.  ``train`` is an SQL condition on
    doc_id that rows must meet to be learnt from.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(F.expr(train)) if train else known
    # Labels may outnumber documents: the smallest hashes are taken among those that have one.
    present = known.join(docs.select(F.col(id_col).alias("doc_id")).dropna().distinct(), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), "doc_id")
    some = [present.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(picked, "doc_id").filter(F.length("text") <= most_chars)
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("y").alias("y")).orderBy(*order)
    return [(r.text, r.y) for r in texts.select("doc_id", "text", "y").collect()]


#: Rows whose crc32(doc_id as text) leaves 0 modulo 5 are held out of all fitting.
HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 0"
