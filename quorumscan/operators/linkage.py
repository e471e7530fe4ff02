"""Complete-linkage clusters of any size, from links between tracks.

Two clusters merge while their largest difference is under the threshold, the closest first, of equal ones that of the
lowest members.  So a cluster never crosses a pair at or above the threshold, and clusters lie within connected components of the
pairs below it:

1. Keys of few tracks are clustered by one task each.
2. Larger keys are split into components, by rounds of joins, and components of few tracks are clustered by one task each.
3. In components that are still larger, clusters that are each other's closest merge in rounds of joins: all at once, for
   a merged cluster is never closer to a third than both of its parts were, so no merge changes another such pair.  The order of
   pairs (difference, lower, higher) is total, so ties end as they do one by one.

Only pairs below the threshold are needed; a pair that is missing is too far apart.

``clusters_of_vectors`` clusters one set of vectors in one task without writing its pairs: by the rounds above over arrays.
What it holds does not grow with the number of pairs: where there are too many, a round finds each cluster's nearest from the vectors, strip by strip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.shared import settled

#: Tracks of a group that one task clusters, by a matrix.
MOST = 2048
#: Where a task clusters vectors: clusters that end by a matrix, pairs under the threshold that it holds at a time, rows and columns of a tile.
FEW, MOST_PAIRS, SIDE = 256, 1 << 24, 256


def complete_linkage(matrix: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers by first appearance; two clusters merge while their largest difference is under ``threshold``.

    The pair with the smallest difference merges first, of equal ones that of the lowest
    members.  Equality does not merge.
    """
    n = len(matrix)
    d = np.array(matrix, float)
    np.fill_diagonal(d, np.inf)
    cluster = np.arange(n)
    # Differences only grow, so a row's nearest changes only where it was one of the two that merge.
    nearest, where = (d.min(axis=1), d.argmin(axis=1)) if n else (np.zeros(0), np.zeros(0, int))
    while n:
        i = int(np.argmin(nearest))
        if not nearest[i] < threshold:
            break
        j = int(where[i])
        cluster[cluster == j] = i
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        again = np.flatnonzero((where == i) | (where == j) | (np.arange(n) == i))
        nearest[again], where[again] = d[again].min(axis=1), d[again].argmin(axis=1)
    number: dict[int, int] = {}
    return [number.setdefault(int(c), len(number)) for c in cluster]


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _strips(x: np.ndarray, clusters: np.ndarray, near: Near, upper: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, largest differences) of clusters, some rows of them at a time; with ``upper`` from the first row's own column on.

    ``near`` has infinity for all that is not under the threshold.
    """
    order = np.argsort(clusters, kind="stable")
    x, of = x[order], clusters[order]
    begins = np.searchsorted(of, np.arange(of[-1] + 2))
    single = len(begins) == len(x) + 1
    a = 0
    while a < len(begins) - 1:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + SIDE, "right")) - 1)
        low = a if upper else 0
        out = np.full((b - a, len(begins) - 1 - low), -np.inf)
        for r in range(begins[a], begins[b], SIDE):
            rows = of[r : min(r + SIDE, begins[b])]
            for c in range(begins[low], len(x), SIDE):
                columns = of[c : c + SIDE]
                d = near(x[r : r + len(rows)], x[c : c + SIDE])
                if single:
                    out[:, c - low : c - low + len(columns)] = d
                    continue
                for axis, names in enumerate((rows, columns)):
                    d = np.maximum.reduceat(d, np.flatnonzero(np.diff(names, prepend=-1)), axis=axis)
                part = out[rows[0] - a : rows[-1] + 1 - a, columns[0] - low : columns[-1] + 1 - low]
                np.maximum(part, d, out=part)
        yield a, low, out
        a = b


def _near_pairs(x: np.ndarray, clusters: np.ndarray, near: Near, most_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs i < j of clusters that are near, in order, and their differences; None where there are too many."""
    found, n = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))], 0
    for a, low, d in _strips(x, clusters, near, True):
        i, j = np.nonzero(d < np.inf)
        upper = i + a < j + low
        i, j = i[upper], j[upper]
        n += len(i)
        if n > most_pairs:
            return None
        found.append(((i + a).astype(np.int32), (j + low).astype(np.int32), d[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _merged_nearest(x: np.ndarray, clusters: np.ndarray, near: Near) -> np.ndarray:
    """Clusters after those that are each other's nearest have merged, numbered by their lowest members."""
    nearest = []
    for a, _, d in _strips(x, clusters, near, False):
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        nearest.append(np.where(np.isinf(d.min(axis=1)), -1, d.argmin(axis=1)))
    nearest = np.concatenate(nearest)
    own = np.arange(len(nearest))
    to = np.where((nearest >= 0) & (nearest[nearest] == own), np.minimum(own, nearest), own)
    return np.unique(to[clusters], return_inverse=True)[1]


def _merged_pairs(n: int, i: np.ndarray, j: np.ndarray, diff: np.ndarray, most: int) -> np.ndarray:
    """The lowest member of each of ``n`` nodes' clusters, from pairs i < j in order: mutual nearest ones merge, then few that are left by a matrix."""
    clusters = np.arange(n)
    while len(i):
        live = np.flatnonzero(np.bincount(i, minlength=n) + np.bincount(j, minlength=n))
        if len(live) <= most:
            matrix = np.full((len(live), len(live)), np.inf)
            a, b = np.searchsorted(live, i), np.searchsorted(live, j)
            matrix[a, b] = matrix[b, a] = diff
            labels = np.array(complete_linkage(matrix, np.inf))
            to = np.arange(n)
            to[live] = live[np.unique(labels, return_index=True)[1][labels]]
            return to[clusters]
        order = np.argsort(diff, kind="stable")  # by difference, lower and higher
        rank = np.full((2, n), len(order))
        for k, end in enumerate((i, j)):
            rank[k, end[order[::-1]]] = np.arange(len(order))[::-1]  # of a node's pairs the first one stays
        rank = rank.min(axis=0)
        best = order[np.unique(rank[live])]
        best = best[rank[i[best]] == rank[j[best]]]
        to, parts = np.arange(n), np.ones(n, np.int64)
        to[j[best]] = i[best]
        parts[i[best]] = 2
        clusters = to[clusters]
        # Merged clusters are near each other only if all their parts were, at the largest of their differences.
        a, b = to[i], to[j]
        key = np.minimum(a, b) * n + np.maximum(a, b)
        order = np.argsort(key, kind="stable")
        order = order[(a != b)[order]]
        key = key[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(begins):
            break
        a, b = np.divmod(key[begins], n)
        whole = np.diff(np.append(begins, len(key))) == parts[a] * parts[b]
        i, j, diff = a[whole].astype(np.int32), b[whole].astype(np.int32), np.maximum.reduceat(diff[order], begins)[whole]
    return clusters


def clusters_of_vectors(x: np.ndarray, near: Near, most: int = FEW, most_pairs: int = MOST_PAIRS) -> np.ndarray:
    """Cluster numbers of rows, by first appearance, as ``complete_linkage`` has them from a matrix.

    ``near`` has the differences of two sets of rows that are under the threshold, and infinity elsewhere.
    """
    clusters = np.arange(len(x))
    while len(x):
        pairs = _near_pairs(x, clusters, near, most_pairs)
        if pairs is not None:
            return np.unique(_merged_pairs(int(clusters.max()) + 1, *pairs, most)[clusters], return_inverse=True)[1]
        clusters = _merged_nearest(x, clusters, near)
    return clusters


def components(links: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """(keys, node, component) of every node of the links (keys, i, j): the smallest node that it is linked to.

    Rounds hang every node, and with it its neighbours, below the smallest node that it sees, until all are stars; a round is two aggregations
    and joins.  Loops and repeated links are ignored.
    """

    def lower(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).filter("i != j").distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "i", "j").cast("decimal(38,0)"))).first())

    now = settled(lower(links), "links")
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
        least = both.groupBy(*keys, "i").agg(F.min("j").alias("m")).select(*keys, "i", F.least("i", "m").alias("m"))
        large = settled(lower(both.join(least, [*keys, "i"]).filter("j > i").select(*keys, F.col("j").alias("i"), F.col("m").alias("j"))), "links")
        least = large.groupBy(*keys, "i").agg(F.min("j").alias("m"))
        small = large.join(least, [*keys, "i"]).select(*keys, F.col("j").alias("i"), F.col("m").alias("j"))
        now = settled(lower(small.union(least.select(*keys, "i", F.col("m").alias("j")))), "links")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = now.select(*keys, F.col("i").alias("node"), F.col("j").alias("component"))
    return ends.union(now.select(*keys, F.col("j").alias("node"), F.col("j").alias("component")).distinct())


def _by_task(links: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(keys, node, cluster) of the links of each group, a matrix in one task."""
    kinds = dict(links.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["i"], rows["j"]]))
        matrix = np.full((len(ids), len(ids)), np.inf)
        a, b = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])
        matrix[a, b] = matrix[b, a] = rows["diff"]
        labels = np.array(complete_linkage(matrix, np.inf))
        _, first = np.unique(labels, return_index=True)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "node": ids, "cluster": ids[first[labels]]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"node {kinds['i']}", f"cluster {kinds['i']}"])
    return links.groupBy(*group).applyInPandas(run, schema)


def _sizes(rows: DataFrame, group: list[str]) -> DataFrame:
    ends = rows.select(*group, F.col("i").alias("node")).union(rows.select(*group, F.col("j").alias("node"))).distinct()
    return ends.groupBy(*group).count()


def _by_rounds(links: DataFrame, keys: list[str], most: int, most_rounds: int) -> DataFrame:
    """(keys, node, cluster) of links whose groups are too large for one task: mutual nearest clusters merge in rounds."""
    order = F.struct("diff", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    pairs = settled(links.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "diff"), "pairs")
    nodes = pairs.select(*keys, F.col("i").alias("node")).union(pairs.select(*keys, F.col("j").alias("node"))).distinct()
    clusters = settled(nodes.withColumn("cluster", F.col("node")), "clusters")
    for _ in range(most_rounds):
        if (_sizes(pairs, keys).agg(F.max("count")).first()[0] or 0) <= most:
            # Few clusters are left: they end in one task, as they would in rounds.
            last = _by_task(pairs, keys, keys).select(*keys, F.col("node").alias("cluster"), F.col("cluster").alias("to"))
            return clusters.join(last, [*keys, "cluster"], "left").select(*keys, "node", F.coalesce("to", "cluster").alias("cluster"))
        both = pairs.union(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "diff"))
        nearest = both.groupBy(*keys, "i").agg(F.min(order).alias("best"))
        # Both ends of a pair have it as their best: it is counted twice.
        mutual = nearest.groupBy(*keys, F.col("best.lo").alias("lo"), F.col("best.hi").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
        merged = settled(mutual.filter("n = 2").select(*keys, F.col("hi").alias("from"), F.col("lo").alias("to")), "merged")
        gone = merged.withColumnRenamed("from", "cluster")
        clusters = settled(clusters.join(gone, [*keys, "cluster"], "left").select(*keys, "node", F.coalesce("to", "cluster").alias("cluster")), "clusters")
        ends = pairs
        for end in ("i", "j"):
            names = merged.select(*keys, F.col("from").alias(end), F.col("to").alias(f"_{end}"))
            into = merged.select(*keys, F.col("to").alias(end), F.lit(2).alias(f"_parts_{end}"))
            ends = ends.join(names, [*keys, end], "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
            ends = ends.join(into, [*keys, end], "left").withColumn(f"_parts_{end}", F.coalesce(f"_parts_{end}", F.lit(1)))
        # Merged clusters are near each other only if all their parts were, at the largest of their differences.
        sides = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
        whole = ends.filter("i != j").select(*keys, *sides, "diff", (F.col("_parts_i") * F.col("_parts_j")).alias("need"))
        whole = whole.groupBy(*keys, "i", "j").agg(F.max("diff").alias("diff"), F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        pairs = settled(whole.filter("n = need").select(*keys, "i", "j", "diff"), "pairs")
    raise RuntimeError(f"clusters did not settle in {most_rounds} rounds")


def clusters(links: DataFrame, keys: list[str], most: int = MOST, most_rounds: int = 10_000) -> DataFrame:
    """(keys, node, cluster) of all nodes of ``links`` (keys, i, j, diff), pairs under the threshold, each once; a cluster is named by its lowest node.

    Nodes without a link are left out.  Groups of more than ``most`` nodes are never held by one task.
    """
    links = links.select(*keys, "i", "j", F.col("diff").cast("double").alias("diff"))
    links = settled(links, "near")

    large = settled(_sizes(links, keys).filter(F.col("count") > most).select(*keys), "large-keys")
    if large.isEmpty():
        return _by_task(links, keys, keys)
    out = _by_task(links.join(large, keys, "left_anti"), keys, keys)
    rest = links.join(large, keys, "left_semi")
    placed = rest.join(components(rest, keys).withColumnRenamed("node", "i"), [*keys, "i"])
    placed = settled(placed, "placed")
    group = [*keys, "component"]
    larger = settled(_sizes(placed, group).filter(F.col("count") > most).select(*group), "large-components")
    out = out.unionByName(_by_task(placed.join(larger, group, "left_anti"), keys, group))
    if larger.isEmpty():
        return out
    return out.unionByName(_by_rounds(placed.join(larger, group, "left_semi").drop("component"), keys, most, most_rounds))
