"""Greedy choice of segments from a window scan, for any threshold X.

What can be decided per window, its snap to a cut and the count there, is decided for all
windows at once.  The walk itself, which skips what lies under a chosen segment, is a fold
over the few windows that qualify, one array per video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumscan.operators.overlap import nearest_cut, overlap_join
from quorumscan.operators.windows import END_SLACK


def candidates(scan: DataFrame, x: int, length: float, step: float, videos: DataFrame | None = None, cuts: DataFrame | None = None, at_cuts: DataFrame | None = None, max_shift: float = 0.0) -> DataFrame:
    """(video, k, start, character_count, raw_start, next_k, raw_count, raw_next_k) of the windows with n >= x.

    With cuts, a start moves to the nearest cut if the window fits there and the count at the cut (``at_cuts``: video, t, n)
    reaches x; only the nearest is ever tried.  ``next_k`` is the first window that starts
    at or after the segment's end; the ``raw`` values are those of the window at its place in the grid.
    """
    good = scan.filter(F.col("n") >= x)
    if cuts is not None and max_shift > 0:
        good = nearest_cut(good, cuts, max_shift).join(videos.select("video", "duration"), "video")
        good = good.join(at_cuts.select("video", F.col("t").alias("cut"), F.col("n").alias("_at_cut")), ["video", "cut"], "left")
        fits = (F.col("cut") + F.lit(float(length)) <= F.col("duration") + F.lit(END_SLACK)) & (F.col("_at_cut") >= x)
        moved = F.coalesce(fits, F.lit(False))
        good = good.withColumn("start", F.when(moved, F.col("cut")).otherwise(F.col("t"))).withColumn("character_count", F.when(moved, F.col("_at_cut")).otherwise(F.col("n")))
    else:
        good = good.withColumn("start", F.col("t")).withColumn("character_count", F.col("n"))

    def after(start: str) -> Column:
        return F.ceil((F.col(start) + F.lit(float(length))) / F.lit(float(step)) - F.lit(1e-9)).cast("long")

    return good.select("video", "k", "start", "character_count", F.col("t").alias("raw_start"), after("start").alias("next_k"), F.col("n").alias("raw_count"), after("t").alias("raw_next_k"))


def select_segments(chosen: DataFrame, length: float, strict_non_overlap: bool = False) -> DataFrame:
    """(video, k, start, end, character_count, raw_start) of the segments of a greedy walk over candidates.

    A start that snapped backwards may lie before the previous segment's end.  This is kept unless
    ``strict_non_overlap``: then such a window stays at its place in the grid, with the count there.
    """
    item = "struct<k:bigint,start:double,character_count:bigint,raw_start:double,next_k:bigint,raw_count:bigint,raw_next_k:bigint>"
    ordered = F.array_sort(F.collect_list(F.struct("k", "start", "character_count", "raw_start", "next_k", "raw_count", "raw_next_k")))
    refused = f"({str(bool(strict_non_overlap)).lower()} AND s.until > w.start)"
    taken = f"""named_struct('k', w.k, 'start', if({refused}, w.raw_start, w.start), 'character_count', if({refused}, w.raw_count, w.character_count),
        'raw_start', w.raw_start, 'next_k', if({refused}, w.raw_next_k, w.next_k), 'raw_count', w.raw_count, 'raw_next_k', w.raw_next_k)"""
    fold = F.expr(f"""
        aggregate(ws, cast(named_struct('next_k', -1L, 'until', -1e308D, 'segments', array()) AS struct<next_k:bigint,until:double,segments:array<{item}>>),
            (s, w) -> if(w.k >= s.next_k,
                named_struct('next_k', if({refused}, w.raw_next_k, w.next_k), 'until', if({refused}, w.raw_start, w.start) + {float(length)}D, 'segments', concat(s.segments, array({taken}))), s),
            s -> s.segments)
    """)
    rows = chosen.groupBy("video").agg(ordered.alias("ws")).select("video", F.explode(fold).alias("w"))
    return rows.select("video", "w.k", "w.start", (F.col("w.start") + F.lit(float(length))).alias("end"), "w.character_count", "w.raw_start")


def replay(scan: DataFrame, x: int, length: float, step: float, strict_non_overlap: bool = False, **snap) -> DataFrame:
    """The segments for a threshold, from a stored scan alone."""
    return select_segments(candidates(scan, x, length, step, **snap), length, strict_non_overlap)


def replay_stored(stored: DataFrame, x: int, length: float, step: float, max_shift: float = 0.0, strict_non_overlap: bool = False) -> DataFrame:
    """Segments with ``snap_shift``, how far each start moved to its cut, from stored scans as ``sources.media.parse_scans`` gives them."""
    windows = stored.select("video", F.posexplode("windows").alias("k", "w")).select("video", F.col("k").cast("long").alias("k"), "w.t", "w.n")
    cuts = stored.select("video", F.explode("cuts").alias("cut"))
    at_cuts = stored.select("video", F.explode("cut_windows").alias("w")).select("video", "w.t", "w.n")
    found = replay(windows, x, length, step, strict_non_overlap, videos=stored.select("video", "duration"), cuts=cuts, at_cuts=at_cuts, max_shift=max_shift)
    return found.withColumn("snap_shift", F.col("start") - F.col("raw_start"))


def with_members(segments: DataFrame, tracks: DataFrame, length: float) -> DataFrame:
    """Segments with the sorted arrays character_ids and track_ids of the tracks that overlap them."""
    key = segments.columns
    inside = overlap_join(segments, tracks.filter("character_id IS NOT NULL").select("video", "track_id", "character_id", "start_time", "end_time"), length, "start")
    found = inside.groupBy(*key).agg(F.sort_array(F.collect_set("character_id")).alias("character_ids"), F.sort_array(F.collect_set("track_id")).alias("track_ids"))
    return segments.join(found, key, "left")


def clip_plan(segments: DataFrame, stems: DataFrame) -> DataFrame:
    """(video, start, end, entry): the path of each segment's clip in an archive, by ``stems`` (video, stem)."""
    from quorumscan.functions.text import stamp

    named = segments.join(stems, "video")
    entry = F.concat(F.col("stem"), F.lit("/"), F.col("stem"), F.lit("_"), stamp(F.col("start")), F.lit("_"), F.col("character_count").cast("string"), F.lit("人.mp4"))
    return named.select("video", "start", "end", entry.alias("entry"))
