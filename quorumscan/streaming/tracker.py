"""The box tracker and window counts over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quorumscan.config import Config
from quorumscan.operators.tracking import TRACKED, BoxTracker, in_order, prepared, track_rows


def stream_tracks(detections: DataFrame, config: Config) -> DataFrame:
    """Detections of a stream with track_id, the same as ``track_boxes`` gives in batch.

    Frames of a video arrive in order.  The state of a video is its open tracks with their last
    boxes; tracks that a gap or a cut has ended are dropped from it with the next frame.
    """
    columns = [c.split()[0] for c in TRACKED.split(", ")]
    base = prepared(detections)
    least_iou, gap = config.iou_threshold, config.track_gap_tolerance

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = BoxTracker(least_iou, gap)
        if state.exists:
            tracker.next_id, opened = json.loads(state.get[0])
            tracker.open = [[i, last, label, tuple(box)] for i, last, label, box in opened]
        rows = pd.concat(list(parts), ignore_index=True)
        ordered = in_order(rows)
        out = track_rows(tracker, ordered)[columns]
        state.update((json.dumps([tracker.next_id, [[i, last, label, [float(x) for x in box]] for i, last, label, box in tracker.open]]),))
        yield out

    return base.groupBy("video").applyInPandasWithState(run, TRACKED, "state string", "append", GroupStateTimeout.NoTimeout)


def sliding_characters(events: DataFrame, time: str, character: str, length: str, step: str, watermark: str) -> DataFrame:
    """Distinct characters per sliding window of a stream, exact: start, end, n; late rows are dropped after ``watermark``.

    Spark has no distinct count over streams.  So each window's characters are made unique in a state of their own, which goes with
    the window when the watermark passes its end, and what is left is counted.  Null characters are not known and do not count.
    Windows come once, when they are over (append mode); those without a row do not come.
    """
    timed = events.withWatermark(time, watermark).filter(F.col(character).isNotNull())
    seen = timed.select(F.window(time, length, step).alias("window"), F.col(character).alias("character")).dropDuplicates(["window", "character"])
    counted = seen.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
