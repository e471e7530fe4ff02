"""Joins by time: overlap of intervals, cuts between samples, nearest and latest cuts.

Spark plans a join on inequalities as a nested loop.  Here both sides are put into bins of
a fixed length first, which makes it an equi-join on (video, bin); each pair is kept in one
bin only, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bin(x: Column, length: float) -> Column:
    return F.floor(x / F.lit(float(length))).cast("long")


def overlap_join(windows: DataFrame, tracks: DataFrame, length: float, start: str = "t") -> DataFrame:
    """Pairs of a window [t, t + length) and a track [start_time, end_time], closed, of one video.

    Windows have video and ``start``; tracks have video, start_time and end_time.  All
    columns of both stay; names other than video must differ.
    """
    t = F.col(start)
    left = windows.withColumn("_bin", F.explode(F.sequence(_bin(t, length), _bin(t + F.lit(float(length)), length)))).withColumn("_lo", _bin(t, length))
    right = tracks.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start_time"), length), _bin(F.col("end_time"), length)))).withColumn("_first", _bin(F.col("start_time"), length))
    pairs = left.join(right, ["video", "_bin"])
    hit = (F.col("start_time") < t + F.lit(float(length))) & (F.col("end_time") >= t)
    once = F.col("_bin") == F.greatest("_lo", "_first")
    return pairs.filter(hit & once).drop("_bin", "_lo", "_first")


def carried(rows: DataFrame, keys: list[str], bin_: str, value: Column, name: str, over: Callable[[str], Column]) -> DataFrame:
    """``rows`` with ``name``: what ``over`` makes of ``value``, an aggregate of each bin, over all earlier bins of their keys.

    A running value over a long video is so split: this much before the bin, and a window within (keys, bin).  Only
    one row for each bin goes through a window over the whole of a key.
    """
    bins = rows.groupBy(*keys, bin_).agg(value.alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(bins.select(*keys, bin_, over("_value").over(earlier).alias(name)), [*keys, bin_])


def cut_between(samples: DataFrame, cuts: DataFrame, tolerance: float, order: str = "frame_index", length: float = 3600.0, frames: int = 10_000) -> DataFrame:
    """Samples (video, time, ``order``) with is_cut: a cut lies in (previous time - tolerance, time + tolerance].

    The first sample of a video has no previous one and no cut.  The latest cut at or before the
    sample's upper end decides, so one pass over the union of both sides in time order is enough.  Both windows
    run within bins, of ``frames`` numbers and ``length`` seconds, and take over what came before.
    """
    binned = samples.withColumn("_bin", F.floor(F.col(order) / frames).cast("long"))
    binned = carried(binned, ["video"], "_bin", F.max_by("time", order), "_before", lambda v: F.last(v, ignorenulls=True))
    within = Window.partitionBy("video", "_bin").orderBy(order)
    timed = binned.withColumn("_prev", F.when(F.row_number().over(within) > 1, F.lag("time").over(within)).otherwise(F.col("_before"))).drop("_bin", "_before")
    marks = cuts.select("video", F.col("cut").alias("_at"), F.lit(0).alias("_side"), F.col("cut").alias("_cut"))
    asked = timed.withColumn("_at", F.col("time") + F.lit(float(tolerance))).withColumn("_side", F.lit(1))
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("_bin", _bin(F.col("_at"), length))
    both = carried(both, ["video"], "_bin", F.max("_cut"), "_before", F.max)
    latest = F.last("_cut", ignorenulls=True).over(Window.partitionBy("video", "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    flagged = both.withColumn("_latest", F.coalesce(latest, "_before")).filter("_side = 1")
    is_cut = F.coalesce(F.col("_latest") > F.col("_prev") - F.lit(float(tolerance)), F.lit(False))
    return flagged.select(*samples.columns, is_cut.alias("is_cut"))


def nearest_cut(points: DataFrame, cuts: DataFrame, max_shift: float, at: str = "t") -> DataFrame:
    """``points`` (video, ``at``, ...) with ``cut``: the nearest within ``max_shift``, the earlier of two as near, else null.

    Points may repeat: they are looked up once each.  ``max_shift`` of 0 or less turns it off.  Only the latest cut
    at or before a point and the first behind it come into question; both are running values over the union of both sides, in bins.
    """
    if max_shift <= 0:
        return points.withColumn("cut", F.lit(None).cast("double"))
    x = F.col(at)
    asked = points.select("video", at).filter(x.isNotNull()).distinct().withColumn("_at", x).withColumn("_side", F.lit(1))
    marks = cuts.filter("cut IS NOT NULL").select("video", F.col("cut").alias("_at"), F.lit(0).alias("_side"), F.col("cut").alias("_cut"))
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("_bin", _bin(F.col("_at"), max_shift))
    bins = both.groupBy("video", "_bin").agg(F.max("_cut").alias("_max"), F.min("_cut").alias("_min"))
    earlier = F.max("_max").over(Window.partitionBy("video").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("_min").over(Window.partitionBy("video").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    both = both.join(bins.select("video", "_bin", earlier.alias("_before"), later.alias("_behind")), ["video", "_bin"])
    within = Window.partitionBy("video", "_bin")
    last = F.coalesce(F.last("_cut", ignorenulls=True).over(within.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)), "_before")
    following = F.coalesce(F.last("_cut", ignorenulls=True).over(within.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)), "_behind")
    found = both.withColumn("_last", last).withColumn("_next", following).filter("_side = 1")
    near = F.array_min(F.filter(F.array(*(F.struct(F.abs(F.col(c) - x).alias("_off"), F.col(c).alias("cut")) for c in ("_last", "_next"))), lambda c: c["_off"] <= float(max_shift)))
    best = found.select("video", at, near["cut"].alias("cut"))
    return points.join(best, ["video", at], "left")


def with_shot(tracks: DataFrame, cuts: DataFrame, length: float = 3600.0) -> DataFrame:
    """Tracks with ``shot``: the number of cuts at or before their start, so one that starts on a cut is in the new shot.

    Cuts are counted within bins of ``length`` seconds, on top of those of all bins before.
    """
    marks = cuts.select("video", F.col("cut").alias("_at"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    asked = tracks.withColumn("_at", F.col("start_time")).withColumn("_side", F.lit(1)).withColumn("_one", F.lit(0))
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("_bin", _bin(F.col("_at"), length))
    both = carried(both, ["video"], "_bin", F.sum("_one"), "_before", F.sum)
    within = F.sum("_one").over(Window.partitionBy("video", "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("shot", (within + F.coalesce("_before", F.lit(0))).cast("long")).filter("_side = 1").select(*tracks.columns, "shot")


def characters_per_shot(tracks: DataFrame, cuts: DataFrame) -> DataFrame:
    """(video, shot, n): distinct known characters whose track starts in the shot; empty shots of videos with cuts have 0."""
    counted = with_shot(tracks, cuts).groupBy("video", "shot").agg(F.countDistinct("character_id").alias("n"))
    shots = cuts.groupBy("video").agg(F.count(F.lit(1)).alias("_cuts")).unionByName(tracks.select("video", F.lit(0).cast(T.LongType()).alias("_cuts")).distinct())
    every = shots.groupBy("video").agg(F.max("_cuts").alias("_cuts")).select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts"))).alias("shot"))
    return every.join(counted, ["video", "shot"], "left").select("video", "shot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
