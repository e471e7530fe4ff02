"""Connected components as a distributed union-find, on DataFrames alone.

Rounds of the large-star and small-star operations hang every node below the smallest
node that it can see, until each component is one star.  A round is a few aggregations and joins;
its result is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import drop_written, written


def _lower(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node u to the smaller node v, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Nodes may be of any orderable type.  Edges may repeat, run both ways or be loops; null
    ends are ignored.  Nodes that have loops only are left out, as is everything of an
    empty table: such a node is its own component.
    """
    now = written(_lower(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()), "edges")
    before = _print(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # Large star: the neighbours of u that are larger than u go below the smallest of all.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_lower(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        # Small star: u and its smaller neighbours go below the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(_lower(joined.union(least.select("u", F.col("m").alias("v")))), "small-star")
        after = _print(small)
        drop_written(large)
        drop_written(now)
        now = small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
