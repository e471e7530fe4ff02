"""Finished tracks of a stream, each with its best samples; the state of a video is bounded and goes when the video ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumscan.config import Config
from quorumscan.operators.tracking import BoxTracker, in_order, prepared

#: What a stream gives for each track that has ended.
FINISHED = "video string, track_id int, label string, start_time double, end_time double, num_detections int, board array<struct<frame_index:int,score:double>>"
OPEN = "track_id int, label string, last_frame int, x1 double, y1 double, x2 double, y2 double, start_time double, end_time double, num_detections int"
BEST = "track_id int, score double, frame_index int"


def sample_score(blur: float | None, confidence: float, frontal: float | None, weight: float) -> float:
    """As ``functions.frontal.representative_score``; a null sharpness is 0, a null frontal score does not count."""
    score = (0.0 if pd.isna(blur) else blur) * confidence
    return score if weight <= 0 or pd.isna(frontal) else score * (1.0 - weight + weight * frontal)


def offered(board: list[tuple[float, int]], score: float, frame: int, k: int, gap: int) -> list[tuple[float, int]]:
    """A board of at most ``k`` (score, frame) by falling score after one more sample; see ``tracking.spaced_representatives``."""
    near = next((b for b in board if abs(b[1] - frame) < gap), None) if gap > 0 else None
    if near is not None:
        if score <= near[0]:
            return board
        board = [b for b in board if b != near]
    return sorted([*board, (score, frame)], key=lambda b: (-b[0], b[1]))[:k]


class TrackBoards(StatefulProcessor):
    """The box tracker of one video.

    State: the number of tracks so far, the open tracks with their last boxes, and a list of the best samples of the open
    tracks, at most ``crops_per_track`` of each.  A track leaves the state with the first frame that shows that it has ended.
    An event-time timer runs ``idle_ms`` behind the latest frame: when it expires, the video has ended, its open tracks are given
    out and nothing of it is left in the state, so ending it again gives nothing.
    """

    def __init__(self, config: Config, idle_ms: int) -> None:
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "next_id int, latest_ms long")
        self.open = handle.getListState("open", OPEN)
        self.best = handle.getListState("best", BEST)

    def _load(self) -> tuple[BoxTracker, dict, dict, int]:
        tracker = BoxTracker(self.config.iou_threshold, self.config.track_gap_tolerance)
        latest, known, boards = 0, {}, {}
        if self.counter.exists():
            tracker.next_id, latest = self.counter.get()
            for track, label, last, x1, y1, x2, y2, start, end, n in self.open.get():
                tracker.open.append([track, last, label, (x1, y1, x2, y2)])
                known[track] = [label, start, end, n]
            for track, score, frame in self.best.get():
                boards.setdefault(track, []).append((score, frame))
        return tracker, known, boards, latest

    def _finished(self, video: str, tracks: list[int], known: dict, boards: dict) -> pd.DataFrame:
        rows = [(video, t, *known.pop(t), [{"frame_index": f, "score": s} for s, f in boards.pop(t)]) for t in sorted(tracks)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FINISHED.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        c = self.config
        tracker, known, boards, latest = self._load()
        every = in_order(pd.concat(list(rows), ignore_index=True))
        for frame, part in every.groupby("frame_index", sort=True):
            real = part[part["x1"].notna()]
            boxes = [(r.label, (r.x1, r.y1, r.x2, r.y2)) for r in real.itertuples()]
            ids = tracker.update(int(frame), bool(part["is_cut"].any()), boxes)
            ended = set(known) - {t[0] for t in tracker.open}
            if ended:
                yield self._finished(key[0], list(ended), known, boards)
            for r, track in zip(real.itertuples(), ids, strict=True):
                now = known.setdefault(track, [r.label, r.time, r.time, 0])
                now[2], now[3] = r.time, now[3] + 1
                boards[track] = offered(boards.get(track, []), sample_score(r.blur_var, r.confidence, r.frontal, c.frontal_weight), int(frame), c.crops_per_track, c.crop_min_gap_frames)
        latest = max(latest, int(every["ts"].max().timestamp() * 1000))
        self.counter.update((tracker.next_id, latest))
        self.open.put([(t, label, last, *map(float, box), known[t][1], known[t][2], known[t][3]) for t, last, label, box in tracker.open])
        self.best.put([(t, float(s), f) for t, board in boards.items() for s, f in board])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, known, boards, _ = self._load()
        for state in (self.counter, self.open, self.best):
            state.clear()
        if known:
            yield self._finished(key[0], list(known), known, boards)

    def close(self) -> None:
        pass


def stream_track_boards(detections: DataFrame, config: Config, idle: float, delay: str = "0 seconds") -> DataFrame:
    """Finished tracks (see ``FINISHED``) of a stream of detections with ts, the time of the frame as a timestamp.

    Frames of a video come in order; a row with a null box is a frame without detections, as after a cut.  A video ends when event time, by the
    watermark of ``delay``, is ``idle`` seconds past its last frame.  Needs the RocksDB state store.
    """
    timed = detections.withColumn("frontal", F.col("frontal") if "frontal" in detections.columns else F.lit(None).cast("double"))
    columns = prepared(timed).columns
    base = timed if "is_cut" in timed.columns else timed.withColumn("is_cut", F.lit(False))
    base = base.select(*(F.col(c) if c in base.columns else F.lit(None).cast("double").alias(c) for c in columns), "ts")
    return base.withWatermark("ts", delay).groupBy("video").transformWithStateInPandas(TrackBoards(config, int(idle * 1000)), FINISHED, "Append", "EventTime")
