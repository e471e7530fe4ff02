"""Who is who: distances between tracks and complete-linkage clusters of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumscan.functions.geometry import normalised
from quorumscan.operators import linkage
from quorumscan.operators.linkage import MOST, complete_linkage  # noqa: F401


#: Vectors of a block of tracks; two blocks are what one task compares at once.
BLOCK = 1024


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows behind their lengths, filled up with 0; of null vectors all is NaN."""
    size = max((len(x) for x in vectors if x is not None), default=0)
    out = np.zeros((len(vectors), size + 1))
    for k, x in enumerate(vectors):
        if x is None:
            out[k] = np.nan
        else:
            out[k, 0], out[k, 1 : len(x) + 1] = len(x), x
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows, products added in the order of the vectors, as ``geometry.dot`` does; NaN where lengths differ."""
    out, product = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for k in range(1, min(x.shape[1], y.shape[1])):
        np.multiply(x[:, k, None], y[None, :, k], out=product)
        out += product
    out[x[:, 0, None] != y[None, :, 0]] = np.nan
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences of all rows of vectors of length 1."""
    return 1.0 - _dots(x, y)


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of all rows, squares added in the order of the vectors; NaN of null ones."""
    out = np.zeros(len(rows))
    for k in range(1, rows.shape[1]):
        out += rows[:, k] * rows[:, k]
    return np.sqrt(np.where(np.isnan(rows[:, 0]), np.nan, out))


def _unit(rows: np.ndarray) -> np.ndarray:
    """The rows brought to length 1, as ``geometry.normalised`` has them; zero ones stay."""
    size = _norms(rows)[:, None]
    out = rows.copy()
    out[:, 1:] /= np.where(size > 0, size, 1.0)
    return out


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """``_apart`` of rows of length 1 (or 0, or null) where it is under the threshold, infinity elsewhere.

    A product of matrices, right to far better than 1e-9, tells which pairs may be; their products are then added in order.
    """
    out = np.full((len(x), len(y)), np.inf)
    with np.errstate(invalid="ignore"):
        i, j = np.nonzero(1.0 - x[:, 1:] @ y[:, 1:].T < threshold + 1e-9)
    same = x[i, 0] == y[j, 0]
    i, j = i[same], j[same]
    often = np.bincount(i, minlength=len(x))
    total, product = np.zeros(len(i)), np.empty(len(i))
    for left, right in zip(np.ascontiguousarray(x.T[1:]), np.ascontiguousarray(y.T[1:]), strict=True):
        np.take(right, j, out=product, mode="clip")
        product *= np.repeat(left, often)
        total += product
    d = 1.0 - total
    d[~(d < threshold)] = np.inf
    out[i, j] = d
    return out


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences of all rows, as ``geometry.cosine_difference`` has them; 1 where a vector is zero or null."""
    size = _norms(x)[:, None] * _norms(y)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - np.where(size > 0, _dots(x, y) / size, 0.0)


def _tiles(x: np.ndarray, y: np.ndarray, side: int = 256, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = _apart) -> Iterator[tuple[int, int, np.ndarray]]:
    for r in range(0, len(x), side):
        for c in range(0, len(y), side):
            yield r, c, apart(x[r : r + side], y[c : c + side])


def _median(x: np.ndarray, y: np.ndarray, bins: int = 1 << 15) -> float:
    """The median of the differences of all rows, in two passes over tiles: bins are counted, then only the middle ones' values are kept."""
    counts = np.zeros(3 * bins, np.int64)

    def places(d: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(d * bins), -bins // 2, 2 * bins + bins // 2 - 1).astype(np.int64) + bins // 2

    for *_, d in _tiles(x, y):
        counts += np.bincount(places(d[~np.isnan(d)]), minlength=len(counts))
    upto = np.cumsum(counts)
    n = int(upto[-1])
    if not n:
        return np.nan
    low, high = (int(np.searchsorted(upto, r, side="right")) for r in ((n - 1) // 2, n // 2))
    kept = []
    for *_, d in _tiles(x, y):
        d = d[~np.isnan(d)]
        at = places(d)
        kept.append(np.unique(d[(at == low) | (at == high)], return_counts=True))
    values, often = (np.concatenate(c) for c in zip(*kept, strict=True))
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(often[order]) + int(upto[low] - counts[low])
    a, b = (values[order[np.searchsorted(reached, r, side="right")]] for r in ((n - 1) // 2, n // 2))
    return 0.5 * a + 0.5 * b


def cropped(crops: DataFrame, keys: list[str], track: str = "track_id") -> DataFrame:
    """(keys, track_id) of the tracks that some difference mentions: those of keys of two or more."""
    own = crops.select(*keys, F.col(track).alias("track_id")).dropna().distinct()
    return own.join(own.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_semi")


def _by_blocks(rows: DataFrame, keys: list[str], bound: float, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, i, j, diff) of all pairs i < j of rows (keys, i, _x) of one vector each, unless the difference is ``bound`` or more; a task compares two blocks."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"i {kinds['i']}", f"j {kinds['i']}", "diff double"])

    def of_blocks(part: pd.DataFrame) -> pd.DataFrame:
        p, q = part["_p"].iloc[0], part["_q"].iloc[0]
        x = part[part["_b"] == p]
        y = x if p == q else part[part["_b"] == q]
        a, b, mx, my = x["i"].to_numpy(), y["i"].to_numpy(), _matrix(x["_x"]), _matrix(y["_x"])
        found = []
        for r, c, d in _tiles(mx, my, apart=apart):
            i, j = a[r : r + len(d), None], b[None, c : c + d.shape[1]]
            u, v = np.nonzero(~(d >= bound) & ((i < j) if p == q else (i != j)))
            i, j = i[u, 0], j[0, v]
            found.append((np.minimum(i, j), np.maximum(i, j), d[u, v]))
        i, j, d = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (a[:0], a[:0], np.zeros(0))
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "i": i, "j": j, "diff": d})

    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_n"))
    placed = rows.join(blocks, keys).withColumn("_b", F.pmod(F.xxhash64("i"), "_n"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    dealt = placed.withColumn("_o", others).withColumn("_p", F.least("_b", "_o")).withColumn("_q", F.greatest("_b", "_o")).drop("_n", "_o")
    return dealt.groupBy(*keys, "_p", "_q").applyInPandas(of_blocks, schema)


def cosine_pairs(vectors: DataFrame, keys: list[str], name: str, feature: str = "feature") -> DataFrame:
    """(keys, i, j, diff) of all pairs of vectors i < j of a key, compared in blocks; ``name`` is unique in a key."""
    rows = vectors.select(*keys, F.col(name).alias("i"), F.transform(feature, lambda x: x.cast("double")).alias("_x"))
    return _by_blocks(rows.dropna(subset=[*keys, "i"]), keys, np.inf, _cosine)


def crop_differences(crops: DataFrame, keys: list[str], track: str = "track_id", feature: str = "feature", below: float | None = None) -> DataFrame:
    """(keys, i, j, diff) of tracks i < j: the median of the cosine differences of all their crops.

    The median of an even number is the mean of the middle two.  Pairs are formed within ``keys`` only, of vectors that are
    brought to length 1 before.  With one crop a track this is that crop's difference: blocks of tracks are compared, and
    with ``below`` only differences under it leave a task.  Otherwise a task compares two tracks, tile by tile.
    """
    rows = crops.select(*keys, F.col(track).alias("i"), normalised(feature).alias("_x")).dropna(subset=[*keys, "i"])
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"i {kinds['i']}", f"j {kinds['i']}", "diff double"])
    bound = np.inf if below is None else float(below)
    tracks = rows.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("_crops"))
    single = (tracks.agg(F.max("_crops")).first()[0] or 1) == 1

    def of_tracks(part: pd.DataFrame) -> pd.DataFrame:
        p, q = part["_p"].iloc[0], part["_q"].iloc[0]
        x, y = part[part["i"] == p], part[part["i"] == q]
        found = [(p, q, _median(_matrix(x["_x"]), _matrix(y["_x"])))] if len(x) and len(y) else []
        found = pd.DataFrame([f for f in found if not f[2] >= bound], columns=["i", "j", "diff"])
        return found.assign(**{k: part[k].iloc[0] for k in keys})[[*keys, "i", "j", "diff"]]

    if single:
        return _by_blocks(rows, keys, bound, _apart)
    others = tracks.select(*keys, F.col("i").alias("_o"))
    dealt = rows.join(others, keys).filter("i != _o").withColumn("_p", F.least("i", "_o")).withColumn("_q", F.greatest("i", "_o")).drop("_o")
    return dealt.groupBy(*keys, "_p", "_q").applyInPandas(of_tracks, schema)


def assign_characters(tracks: DataFrame, differences: DataFrame, threshold: float | str, key: str = "video", most: int = MOST, known: DataFrame | None = None) -> DataFrame:
    """``tracks`` (key, track_id, ...) with character_id from complete-linkage clusters of all tracks of a key.

    ``threshold`` is a number, or the column of ``differences`` that has each key's own.
    Tracks that no difference mentions have no crop and so no known character: null.  With ``known`` (key, track_id) these are the
    ones that have a crop, and ``differences`` may lack pairs that are too far apart.  Characters are numbered by
    their first track.  A key of more than ``most`` tracks is split (see ``linkage``), so no task holds it whole.
    """
    bound = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    if known is None:
        known = differences.select(key, F.explode(F.array("i", "j")).alias("track_id")).distinct()
    found = linkage.clusters(differences.filter(F.col("diff") < bound), [key], most)
    named = known.join(found.withColumnRenamed("node", "track_id"), [key, "track_id"], "left").select(key, "track_id", F.coalesce("cluster", "track_id").alias("_cluster"))
    numbers = named.select(key, "_cluster").distinct()
    numbers = numbers.withColumn("character_id", (F.row_number().over(Window.partitionBy(key).orderBy("_cluster")) - 1).cast("int"))
    labelled = named.join(numbers, [key, "_cluster"]).drop("_cluster")
    return tracks.drop("character_id").join(labelled, [key, "track_id"], "left")


def window_scope_counts(members: DataFrame, differences: DataFrame, threshold: float | str, key: str = "video", most: int = MOST, known: DataFrame | None = None) -> DataFrame:
    """(key, k, n): characters in window k when only its own tracks are clustered.

    ``members`` has (key, k, track_id).  Windows with the same set of tracks are clustered once;
    tracks that no difference mentions are left out.  ``threshold`` is a number, or the column of ``differences`` that has each key's own.
    A window of more than ``most`` tracks is split (see ``linkage``).  ``known`` is as in ``assign_characters``.
    """
    bound = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    if known is None:
        known = differences.select(key, F.explode(F.array("i", "j")).alias("track_id")).distinct()
    sets = members.join(known, [key, "track_id"], "left_semi").groupBy(key, "k").agg(F.sort_array(F.collect_set("track_id")).alias("tracks"))
    signed = sets.withColumn("signature", F.sha2(F.to_json("tracks"), 256))
    distinct = signed.groupBy(key, "signature").agg(F.first("tracks").alias("tracks")).select(key, "signature", F.explode("tracks").alias("i"))
    # Only pairs under the threshold can merge; each pair that does not happen leaves a character of its own.
    near = differences.filter(F.col("diff") < bound).select(key, "i", "j", "diff")
    pairs = distinct.join(near, [key, "i"]).join(distinct.select(key, "signature", F.col("i").alias("j")), [key, "signature", "j"])
    found = linkage.clusters(pairs, [key, "signature"], most)
    merged = found.groupBy(key, "signature").agg((F.count(F.lit(1)) - F.countDistinct("cluster")).alias("merged"))
    out = signed.join(merged, [key, "signature"], "left").select(key, "k", (F.size("tracks") - F.coalesce("merged", F.lit(0))).alias("n"))
    every = members.select(key, "k").distinct()
    return every.join(out, [key, "k"], "left").select(key, "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Windows in a row whose tracks' vectors go to one task together.
ROW = 24


def window_scope_counts_of_crops(members: DataFrame, crops: DataFrame, threshold: float, key: str = "video", most: int = MOST) -> DataFrame:
    """(key, k, n) as ``window_scope_counts`` has it from the differences of ``crops`` (key, track_id, feature), ``k`` a number; no pair of tracks leaves a task.

    A task gets the members of ``ROW`` windows of a key and the vector of each of their tracks once, and clusters one window after the other (see
    ``linkage.clusters_of_vectors``); equal sets of tracks are clustered once.  Time grows with the square of a window's tracks, what is shuffled with their
    number.  A window counts every track that has a crop.  Tracks of several crops need the median of their differences, which are made before.
    """
    rows = crops.select(key, "track_id", "feature").dropna(subset=[key, "track_id"])
    tracks = rows.groupBy(key, "track_id").agg(F.count(F.lit(1)).alias("_crops"))
    if (tracks.agg(F.max("_crops")).first()[0] or 1) > 1:
        return window_scope_counts(members, crop_differences(rows, [key], below=threshold), threshold, key, most, tracks.select(key, "track_id"))
    inside = members.select(key, "k", "track_id").join(rows.select(key, "track_id"), [key, "track_id"], "left_semi").withColumn("_row", F.floor(F.col("k") / ROW))
    # Under names of their own: Spark does not cogroup a table with what was made of it.
    vectors = inside.select(key, "_row", "track_id").distinct().join(rows, [key, "track_id"])
    vectors = vectors.select(F.col(key).alias("_key"), F.col("_row").alias("_of"), F.col("track_id").alias("_track"), F.col("feature").alias("_x"))
    kinds = dict(members.dtypes)

    def count(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_track")
        x = _unit(_matrix(own["_x"]))
        at = np.searchsorted(own["_track"].to_numpy(), part["track_id"].to_numpy())
        known: dict[bytes, int] = {}
        found = []
        for k, mine in part.assign(at=at).groupby("k")["at"]:
            mine = np.unique(mine.to_numpy())
            if (name := mine.tobytes()) not in known:
                known[name] = int(linkage.clusters_of_vectors(x[mine], lambda a, b: _near(a, b, threshold)).max()) + 1
            found.append((k, known[name]))
        out = pd.DataFrame(found, columns=["k", "n"])
        return out.assign(**{key: part[key].iloc[0] if len(part) else None})[[key, "k", "n"]]

    out = inside.groupBy(key, "_row").cogroup(vectors.groupBy("_key", "_of")).applyInPandas(count, f"`{key}` {kinds[key]}, k {kinds['k']}, n long")
    every = members.select(key, "k").distinct()
    return every.join(out, [key, "k"], "left").select(key, "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dense_labels(rows: DataFrame, key: str, raw: str, order: str) -> DataFrame:
    """``rows`` with label: raw labels numbered from 0 by first appearance in ``order``."""
    first = F.min(order).over(Window.partitionBy(key, raw))
    return rows.withColumn("_first", first).withColumn("label", F.dense_rank().over(Window.partitionBy(key).orderBy("_first")) - 1).drop("_first")
