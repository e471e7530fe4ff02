"""The window scan: how many distinct characters each window of a video shows.

It does not depend on the threshold X, so it is made once and replayed for any X.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumscan.operators.overlap import carried, overlap_join

#: Slack with which a window may end behind the video.
END_SLACK = 1e-6


def window_grid(videos: DataFrame, length: float, step: float) -> DataFrame:
    """(video, k, t) of the windows [k * step, k * step + length) that lie in the video; starts are never summed up."""
    last = F.floor((F.col("duration") + F.lit(END_SLACK) - F.lit(float(length))) / F.lit(float(step))).cast("long")
    grid = videos.select("video", "duration", F.explode(F.when(last >= -1, F.sequence(F.lit(0).cast("long"), last + 1)).otherwise(F.array().cast("array<bigint>"))).alias("k"))
    grid = grid.withColumn("t", F.col("k") * F.lit(float(step)))
    return grid.filter(F.col("t") + F.lit(float(length)) <= F.col("duration") + F.lit(END_SLACK)).select("video", "k", "t")


def count_characters(windows: DataFrame, tracks: DataFrame, length: float, step: float, least_seconds: float = 0.0, start: str = "t") -> DataFrame:
    """``windows`` with n: distinct known characters of overlapping tracks; windows without any have 0.

    With ``least_seconds`` a character counts only if its tracks there sum up to that screen
    time (samples times ``step``), which takes pairs of windows and tracks; without, running counts do (see ``running_counts``).
    """
    if least_seconds <= 0:
        return running_counts(windows, tracks, length, start)
    known = tracks.filter("character_id IS NOT NULL").select("video", "start_time", "end_time", "character_id", "num_detections")
    key = windows.columns
    shown = overlap_join(windows, known, length, start).groupBy(*key, "character_id").agg(F.sum(F.col("num_detections") * F.lit(float(step))).alias("seconds"))
    shown = shown.filter(F.col("seconds") >= least_seconds)
    counted = shown.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return windows.join(counted, key, "left").select(*key, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def running_counts(windows: DataFrame, tracks: DataFrame, length: float, start: str = "t") -> DataFrame:
    """``windows`` with n, by running counts: no pairs, however many windows and tracks overlap.

    A character's tracks become stays that no window [t, t + length) meets two of: a track goes on with what came before if it begins
    before a window that starts at the last end would end.  Then n is the number of stays that begin before the window ends, less those that end before it starts.
    """
    span, t = F.lit(float(length)), F.col(start)
    known = tracks.filter("character_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL").select("video", "character_id", "start_time", "end_time")
    own = Window.partitionBy("video", "character_id").orderBy("start_time", "end_time")
    until = F.max("end_time").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = known.withColumn("_until", until).withColumn("_new", F.when(F.col("start_time") < F.col("_until") + span, 0).otherwise(1))
    numbered = fresh.withColumn("_stay", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    stays = numbered.groupBy("video", "character_id", "_stay").agg(F.min("start_time").alias("begin"), F.max("end_time").alias("end"))

    def both(begin, end):
        return F.explode(F.array(F.struct(F.lit(1).alias("sign"), begin.alias("at")), F.struct(F.lit(-1).alias("sign"), end.alias("at"))))

    marks = stays.select("video", both(F.col("begin"), F.col("end")).alias("m")).select("video", "m.sign", "m.at", F.lit(1).alias("_side"), F.lit(1).alias("_one"), F.lit(None).cast("double").alias("_t"))
    asked = windows.select("video", t.alias("_t")).filter("_t IS NOT NULL").distinct().select("video", "_t", both(F.col("_t") + span, F.col("_t")).alias("m"))
    asked = asked.select("video", "m.sign", "m.at", F.lit(0).alias("_side"), F.lit(0).alias("_one"), "_t")
    rows = marks.unionByName(asked).withColumn("_bin", F.floor(F.col("at") / span).cast("long"))
    rows = carried(rows, ["video", "sign"], "_bin", F.sum("_one"), "_before", F.sum)
    within = Window.partitionBy("video", "sign", "_bin").orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_n", F.col("sign") * (F.coalesce("_before", F.lit(0)) + F.sum("_one").over(within))).filter("_side = 0")
    counted = met.groupBy("video", F.col("_t").alias(start)).agg(F.sum("_n").alias("_n"))
    return windows.join(counted, ["video", start], "left").select(*windows.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def window_scan(videos: DataFrame, tracks: DataFrame, length: float, step: float, least_seconds: float = 0.0) -> DataFrame:
    """(video, k, t, n) of every window of every video."""
    return count_characters(window_grid(videos, length, step), tracks, length, step, least_seconds)


def cut_scan(videos: DataFrame, cuts: DataFrame, tracks: DataFrame, length: float, step: float, least_seconds: float = 0.0) -> DataFrame:
    """(video, t, n) of the windows that start at a cut and lie in the video."""
    starts = cuts.join(videos, "video").filter(F.col("cut") + F.lit(float(length)) <= F.col("duration") + F.lit(END_SLACK)).select("video", F.col("cut").alias("t")).distinct()
    return count_characters(starts, tracks, length, step, least_seconds)


def sensitivity(scan: DataFrame, thresholds: list[int], keys: list[str] | None = None) -> DataFrame:
    """For each X the number of windows with n >= X, of all windows, and their share.

    One pass: a count per threshold, then a row for each.
    """
    counts = [F.count_if(F.col("n") >= x).alias(f"_{x}") for x in thresholds]
    one = scan.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"_{x}").alias("hits")) for x in thresholds))).alias("r")
    out = one.select(*(keys or []), "total", rows).select(*(keys or []), "r.x", "r.hits", "total")
    return out.withColumn("share", F.col("hits") / F.greatest(F.col("total"), F.lit(1)))


def curve(scan: DataFrame, points: int = 200) -> DataFrame:
    """(video, bucket, n): the scan thinned to at most ``points`` buckets by their maximum; short scans stay as they are.

    Bucket i covers places [int(i * s), max(int((i + 1) * s), int(i * s) + 1)) with s = windows / points.
    """
    sized = scan.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("video")))
    step = F.greatest(F.lit(1.0), F.col("_size") / F.lit(float(points)))
    near = F.floor(F.col("k") / step).cast("long")
    # Rounding may put a place next to its bucket: the bounds decide among three.
    tried = sized.withColumn("_step", step).withColumn("bucket", F.explode(F.sequence(F.greatest(near - 1, F.lit(0)), near + 1)))
    lo = F.floor(F.col("bucket") * F.col("_step")).cast("long")
    hi = F.greatest(F.floor((F.col("bucket") + 1) * F.col("_step")).cast("long"), lo + 1)
    held = tried.filter((F.col("k") >= lo) & (F.col("k") < hi) & (F.col("bucket") < F.least(F.col("_size"), F.lit(points))))
    return held.groupBy("video", "bucket").agg(F.max("n").alias("n"))
