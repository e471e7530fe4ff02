"""Whole analyses: from detections to tracks and a scan, from a scan to segments, and sweeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.operators import gates, identity, selection, style, tracking, windows
from quorumscan.operators.overlap import cut_between, overlap_join


@dataclass
class Analysis:
    """What an analysis leaves behind; the scans answer any threshold X."""

    tracks: DataFrame
    window_scan: DataFrame
    cut_scan: DataFrame
    videos: DataFrame
    cuts: DataFrame
    config: Config

    def segments(self, x: int | None = None) -> DataFrame:
        c = self.config
        chosen = selection.candidates(self.window_scan, x or c.min_events_per_window, c.window_seconds, c.frame_interval, self.videos, self.cuts, self.cut_scan, c.clip_snap_max_shift)
        found = selection.select_segments(chosen, c.window_seconds, c.strict_non_overlap)
        return selection.with_members(found, self.tracks, c.window_seconds)


def analyze(detections: DataFrame, cuts: DataFrame, differences: DataFrame, videos: DataFrame, config: Config, frames: DataFrame | None = None) -> Analysis:
    """Gate, track, identify and scan.

    ``differences`` (video, i, j, diff) compares tracks by the embedder.  Frames after a cut are those of ``frames``, if given, or
    are told by ``cuts``.  With cluster_scope
    "window" every window clusters its own tracks; the characters of segments are always those of the video.
    """
    good = detections.filter(gates.passes_quality(config) & gates.passes_frontal(config))
    tracks = gates.drop_short_tracks(tracking.tracks_of(tracking.track_boxes(good, config, _cut_frames(good, cuts, config, frames))), config.min_track_seconds)
    known = identity.assign_characters(tracks, differences, config.threshold())
    length, step = config.window_seconds, config.frame_interval
    scan = windows.window_scan(videos, known, length, step, config.min_character_seconds)
    at_cuts = windows.cut_scan(videos, cuts, known, length, step, config.min_character_seconds)
    if config.cluster_scope == "window":
        scan = _window_scope(scan, ["video", "k", "t"], known, differences, config)
        at_cuts = _window_scope(at_cuts, ["video", "t"], known, differences, config)
    return Analysis(known, scan, at_cuts, videos, cuts, config)


def _cut_frames(detections: DataFrame, cuts: DataFrame, config: Config, frames: DataFrame | None) -> DataFrame | None:
    """Frames with is_cut: a cut lies between them and the frame before that has a detection, within the tolerance."""
    if frames is not None or "is_cut" in detections.columns:
        return frames
    return cut_between(detections.groupBy("video", "frame_index").agg(F.min("time").alias("time")), cuts, config.cut_time_tolerance)


def analyze_styles(detections: DataFrame, cuts: DataFrame, differences: DataFrame, videos: DataFrame, config: Config, frames: DataFrame | None = None) -> Analysis:
    """As ``analyze``, for ``videos`` (video, duration, style) of any styles in one plan.

    Each video has its style's least face height and identity threshold (see ``style.styled``); what a style does not set is the config's.
    """
    films = style.styled(videos, config)
    records = style.styled_records(detections, films, config).filter("kept")
    tracks = gates.drop_short_tracks(tracking.tracks_of(tracking.track_boxes(records, config, _cut_frames(records, cuts, config, frames))), config.min_track_seconds)
    apart = style.with_settings(differences, films, "identity_threshold")
    known = identity.assign_characters(tracks, apart, "identity_threshold")
    length, step = config.window_seconds, config.frame_interval
    scan = windows.window_scan(videos, known, length, step, config.min_character_seconds)
    at_cuts = windows.cut_scan(videos, cuts, known, length, step, config.min_character_seconds)
    if config.cluster_scope == "window":
        scan = _window_scope(scan, ["video", "k", "t"], known, apart, config, "identity_threshold")
        at_cuts = _window_scope(at_cuts, ["video", "t"], known, apart, config, "identity_threshold")
    return Analysis(known, scan, at_cuts, videos, cuts, config)


def _window_scope(scan: DataFrame, key: list[str], tracks: DataFrame, differences: DataFrame, config: Config, threshold: float | str | None = None) -> DataFrame:
    named = scan.select(*key).withColumn("k", F.col("k") if "k" in key else F.col("t"))
    inside = overlap_join(named, tracks.select("video", "track_id", "start_time", "end_time"), config.window_seconds)
    counts = identity.window_scope_counts(inside.select("video", "k", "track_id"), differences, config.threshold() if threshold is None else threshold)
    joined = named.join(counts, ["video", "k"], "left")
    return joined.select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sweep(tracks: DataFrame, differences: DataFrame, videos: DataFrame, config: Config, thresholds: list[float], xs: list[int], cropped: DataFrame | None = None) -> DataFrame:
    """(video, threshold, x, n_characters, n_segments) over a grid, in one plan; differences are computed once by the caller.

    Each video is taken once for each threshold, under a name of its own, and each of those once for each X.  With ``cropped`` (video, track_id),
    the tracks that have a crop, ``differences`` may lack pairs that are too far apart for any threshold.
    """
    grid = F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(thresholds)))))

    def named(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("_of", F.col("video")).withColumn("video", F.to_json(F.struct(F.col(by).alias("by"), F.col("video").alias("of"))))

    # Each threshold gets the pairs below it alone; that a track has a crop is told once for all of them.
    if cropped is None:
        cropped = differences.select("video", F.explode(F.array("i", "j")).alias("track_id")).distinct()
    near = differences.withColumn("threshold", grid).filter("diff < threshold")
    apart, films, own = (named(rows, "threshold").drop("_of") for rows in (near, videos.withColumn("threshold", grid), cropped.withColumn("threshold", grid)))
    known = identity.assign_characters(named(tracks.withColumn("threshold", grid), "threshold").drop("_of", "threshold"), apart, "threshold", known=own.drop("threshold"))
    scan = windows.window_scan(films, known, config.window_seconds, config.frame_interval)
    sizes = known.groupBy("video").agg(F.countDistinct("character_id").alias("n_characters"))
    every = F.explode(F.array(*(F.lit(int(x)) for x in sorted(set(xs)))))
    # A window counts for every X that it reaches; the walk then needs no other threshold than 0.
    reached = named(scan.withColumn("x", every).filter("n >= x"), "x").drop("_of", "x")
    found = selection.replay(reached, 0, config.window_seconds, config.frame_interval).groupBy("video").agg(F.count(F.lit(1)).alias("_n"))
    rows = named(named(videos.select("video").withColumn("threshold", grid), "threshold").withColumnRenamed("_of", "_film").withColumn("x", every), "x")
    rows = rows.join(sizes.withColumnRenamed("video", "_of"), "_of", "left").join(found, "video", "left")
    return rows.select(F.col("_film").alias("video"), "threshold", "x", F.coalesce("n_characters", F.lit(0)).alias("n_characters"), F.coalesce("_n", F.lit(0)).alias("n_segments"))
