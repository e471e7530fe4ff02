"""Tracks from detections: by gaps for known labels, by greedy IoU matching for boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.operators.overlap import carried

TRACKED = "video string, track_id int, label string, frame_index int, time double, x1 int, y1 int, x2 int, y2 int, confidence double, blur_var double, frontal double"


def sessionise(events: DataFrame, keys: list[str], time: str, gap: float, order: str | None = None) -> DataFrame:
    """``events`` with track_no: 0 for a key's first run, one more wherever more than ``gap`` has passed."""
    w = Window.partitionBy(*keys).orderBy(time, *([order] if order else []))
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > F.lit(gap)).cast("long"), F.lit(0))
    return events.withColumn("_new", new).withColumn("track_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def roll_up(samples: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """One row per track: start_time, end_time, num_detections."""
    return samples.groupBy(*keys).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("num_detections"))


def representatives(samples: DataFrame, keys: list[str], score: Column, order: str, k: int = 1) -> DataFrame:
    """The ``k`` best samples of each track with their ``rank`` from 0; of equal scores the earliest comes first."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col(order))
    return samples.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def spaced_representatives(samples: DataFrame, keys: list[str], score: Column, frame: str, k: int, gap: int) -> DataFrame:
    """As ``representatives``, but two kept samples of a track lie ``gap`` frames or more apart.

    Samples come in frame order.  One within ``gap`` frames of a kept one replaces the first such
    (best score first) if its score is higher, and is dropped otherwise; any other is
    kept while there is room or it beats the worst.  Kept samples are a fold's state of at most ``k``.
    """
    if gap <= 0:
        return representatives(samples, keys, score, frame, k).select(*keys, "rank", frame, score.alias("score"))
    item = "struct<neg:double,f:long>"
    feed = F.array_sort(F.collect_list(F.struct(F.col(frame).cast("long").alias("f"), (-score).cast("double").alias("neg"))))
    # b is the board by falling score, ties by frame; x the sample that comes.
    entered = "slice(array_sort(concat(b, array(named_struct('neg', x.neg, 'f', x.f)))), 1, {k})"
    replaced = "array_sort(concat(filter(b, e -> e.f != near.f), array(named_struct('neg', x.neg, 'f', x.f))))"
    step = f"""(b, x) -> get(transform(array(get(filter(b, e -> abs(e.f - x.f) < {int(gap)}), 0)), near ->
        CASE WHEN near IS NULL THEN {entered.format(k=int(k))} WHEN x.neg < near.neg THEN {replaced} ELSE b END), 0)"""
    board = F.expr(f"aggregate(feed, cast(array() AS array<{item}>), {step})")
    return samples.groupBy(*keys).agg(feed.alias("feed")).select(*keys, F.posexplode(board).alias("rank", "b")).select(*keys, "rank", F.col("b.f").alias(frame), (-F.col("b.neg")).alias("score"))


class BoxTracker:
    """State of one video's tracker: open tracks with their last box.

    ``update`` takes the boxes of a frame in order and gives their track ids.  A track ends
    when more than ``gap`` frames were missed or a cut comes between.  Pairs of one label with an
    IoU of ``least_iou`` or more are matched from the highest (IoU, track, box) down, each side once.
    """

    def __init__(self, least_iou: float, gap: int) -> None:
        self.least_iou, self.gap, self.next_id = least_iou, gap, 0
        self.open: list[list] = []  # [track id, last frame, label, box]

    def update(self, frame: int, is_cut: bool, boxes: list[tuple]) -> list[int]:
        if is_cut:
            self.open = []
        self.open = [t for t in self.open if frame - t[1] - 1 <= self.gap]
        pairs = sorted(((overlap(t[3], b[1]), i, j) for i, t in enumerate(self.open) for j, b in enumerate(boxes) if t[2] == b[0]), reverse=True)
        ids: list[int | None] = [None] * len(boxes)
        taken: set[int] = set()
        for share, i, j in pairs:
            if share >= self.least_iou and i not in taken and ids[j] is None:
                taken.add(i)
                ids[j] = self.open[i][0]
                self.open[i][1], self.open[i][3] = frame, boxes[j][1]
        for j, (label, box) in enumerate(boxes):
            if ids[j] is None:
                ids[j] = self.next_id
                self.open.append([self.next_id, frame, label, box])
                self.next_id += 1
        return ids


def overlap(a: tuple, b: tuple) -> float:
    width, height = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0, width) * max(0, height)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def track_rows(tracker: BoxTracker, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one video in frame order with track_id, through a tracker that may go on afterwards.

    Rows with a null box are frames without detections; they carry cuts and give no rows.
    """
    rows = rows[rows["frame_index"].notna()]
    order = np.argsort(rows["frame_index"].to_numpy(), kind="stable")
    frames, cut, real = (x[order].tolist() for x in (rows["frame_index"].to_numpy(), rows["is_cut"].to_numpy(bool), rows["x1"].notna().to_numpy()))
    label, *sides = (rows[c].to_numpy()[order].tolist() for c in ("label", "x1", "y1", "x2", "y2"))
    boxes = list(zip(label, zip(*sides, strict=True), strict=True))
    kept: list[int] = []
    ids: list[int] = []
    at, n = 0, len(frames)
    while at < n:
        end = at + 1
        while end < n and frames[end] == frames[at]:
            end += 1
        mine = [k for k in range(at, end) if real[k]]
        ids += tracker.update(int(frames[at]), any(cut[at:end]), [boxes[k] for k in mine])
        kept += mine
        at = end
    out = rows.iloc[order[kept]].copy()
    out["track_id"] = ids
    return out


def prepared(detections: DataFrame) -> DataFrame:
    """The tracker's columns of a table that may lack some, and is_cut."""
    base = detections if "is_cut" in detections.columns else detections.withColumn("is_cut", F.lit(False))
    needed = [c.split()[0] for c in TRACKED.split(", ") if not c.startswith("track_id")]
    return base.select(*(F.col(c) if c in base.columns else F.lit(None).cast("double").alias(c) for c in needed), F.coalesce("is_cut", F.lit(False)).alias("is_cut"))


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Boxes of a video as the tracker takes them: by frame, then by place, then by label."""
    return rows.sort_values(["frame_index", "x1", "y1", "x2", "y2", "label"], kind="stable", na_position="last").reset_index(drop=True)


def stretches(seen: DataFrame, cuts: DataFrame, gap: int, frames: int = 10_000) -> DataFrame:
    """(video, label, frame_index, stretch) of every frame in which a label is seen; no track goes from one stretch to another.

    A stretch is named by its first frame.  One begins where more than ``gap`` frames lack the label, or a cut (video, frame_index) has come
    since it was seen last.  All running values are taken within bins of ``frames`` frames, over what came before the bin.
    """
    marks = seen.select("video", "label", "frame_index").distinct().withColumn("_cut", F.lit(0))
    marks = marks.unionByName(cuts.select("video", F.lit(None).cast("string").alias("label"), "frame_index", F.lit(1).alias("_cut")).distinct())
    binned = marks.withColumn("_bin", F.floor(F.col("frame_index") / frames).cast("long"))
    binned = carried(binned, ["video"], "_bin", F.sum("_cut"), "_before", F.sum)
    so_far = Window.partitionBy("video", "_bin").orderBy("frame_index").rangeBetween(Window.unboundedPreceding, 0)
    counted = binned.withColumn("_cuts", F.coalesce("_before", F.lit(0)) + F.sum("_cut").over(so_far)).filter("_cut = 0").drop("_before", "_cut")

    here = F.struct("frame_index", "_cuts")
    counted = carried(counted, ["video", "label"], "_bin", F.max(here), "_before", F.max)
    within = Window.partitionBy("video", "label", "_bin").orderBy("frame_index")
    last = F.coalesce(F.lag(here).over(within), "_before")
    fresh = last.isNull() | (F.col("frame_index") - last["frame_index"] - 1 > gap) | (last["_cuts"] != F.col("_cuts"))
    begun = counted.withColumn("_from", F.when(fresh, F.col("frame_index"))).drop("_before")
    begun = carried(begun, ["video", "label"], "_bin", F.max("_from"), "_before", F.max)
    stretch = F.coalesce(F.max("_from").over(within.rowsBetween(Window.unboundedPreceding, 0)), "_before")
    return begun.select("video", "label", "frame_index", stretch.alias("stretch"))


def track_boxes(detections: DataFrame, config: Config, frames: DataFrame | None = None, bin_frames: int = 10_000) -> DataFrame:
    """Detections with track_id; ``frames`` (video, frame_index, is_cut) marks frames after a cut.

    Tracks never leave a stretch of their label (see ``stretches``), so stretches, not videos, are what is spread over tasks.
    Tracks are numbered from 0 in each video by where they open, as one tracker that sees the whole video would.
    """
    base = prepared(detections).withColumn("_label", F.coalesce("label", F.lit("")))
    cuts = base.filter("is_cut").select("video", "frame_index")
    if frames is not None:
        cuts = frames.filter("is_cut").select("video", "frame_index")
    columns = [c.split()[0] for c in TRACKED.split(", ")]
    real = base.filter("x1 IS NOT NULL").drop("is_cut")
    least_iou, gap = config.iou_threshold, config.track_gap_tolerance
    placed = real.join(stretches(real.select("video", F.col("_label").alias("label"), "frame_index"), cuts, gap, bin_frames).withColumnRenamed("label", "_label"), ["video", "_label", "frame_index"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = in_order(rows)
        ordered["is_cut"] = ordered["stretch"] == ordered["frame_index"]  # nothing is open where a stretch begins
        out = track_rows(BoxTracker(least_iou, gap), ordered)
        out["_opens"] = ~out.duplicated("track_id")
        return out[[*columns, "_label", "_group", "_opens"]]

    # Short stretches are many: those that begin in the same bin of frames go to one call.
    grouped = placed.withColumn("_group", F.floor(F.col("stretch") / bin_frames).cast("long"))
    tracked = grouped.groupBy("video", "_label", "_group").applyInPandas(run, f"{TRACKED}, _label string, _group long, _opens boolean")
    own = tracked.withColumnRenamed("track_id", "_own")
    opened = own.filter("_opens").withColumn("_bin", F.floor(F.col("frame_index") / bin_frames).cast("long"))
    opened = carried(opened, ["video"], "_bin", F.count(F.lit(1)), "_before", F.sum)
    order = Window.partitionBy("video", "_bin").orderBy("frame_index", "x1", "y1", "x2", "y2", F.col("label").asc_nulls_last(), "_group", "_own")
    numbered = opened.select("video", "_label", "_group", "_own", (F.coalesce("_before", F.lit(0)) + F.row_number().over(order) - 1).cast("int").alias("track_id"))
    return own.join(numbered, ["video", "_label", "_group", "_own"]).select(*columns)


def tracks_of(tracked: DataFrame) -> DataFrame:
    """Tracks by start: video, track_id, label, start_time, end_time, num_detections."""
    return tracked.groupBy("video", "track_id", "label").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).cast("int").alias("num_detections"))


def by_start(tracks: DataFrame) -> DataFrame:
    """Tracks of each video by start, those that start together as they were opened."""
    return tracks.orderBy("video", "start_time", "track_id")
