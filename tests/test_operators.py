"""Hand-computed cases of the engine's operators (the golden cases of FIXTURES.md)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.functions import frontal, geometry, metrics, text
from quorumscan.operators import catalog, evaluation, gates, identity, overlap, selection, tracking, windows
from quorumscan.plans.pipeline import analyze, sweep
from quorumscan.sources import media

W, STEP = 5.0, 1.0
SMALL = Config(window_seconds=W, frame_interval=STEP, min_events_per_window=2, clip_snap_max_shift=2.0, iou_threshold=0.3, track_gap_tolerance=1)
TRACKS = "video string, track_id int, start_time double, end_time double, num_detections int, character_id int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def tracks(spark, rows):
    """Rows (start, end, character) of video v as tracks numbered from 1."""
    return spark.createDataFrame([("v", k + 1, float(a), float(b), int((b - a) / STEP) + 1, c) for k, (a, b, c) in enumerate(rows)], TRACKS)


def videos(spark, duration):
    return spark.createDataFrame([("v", float(duration))], "video string, duration double")


def cuts(spark, times):
    return spark.createDataFrame([("v", float(t)) for t in times], "video string, cut double")


def segments(spark, rows, duration, times=(), x=2, strict=False, shift=2.0):
    t, v, c = tracks(spark, rows), videos(spark, duration), cuts(spark, times)
    scan = windows.window_scan(v, t, W, STEP)
    chosen = selection.candidates(scan, x, W, STEP, v, c, windows.cut_scan(v, c, t, W, STEP), shift)
    found = selection.select_segments(chosen, W, strict)
    return [(r.start, r.end, r.character_count, r.raw_start, r.character_ids, r.track_ids) for r in selection.with_members(found, t, W).orderBy("k").collect()]


# -- boxes and faces ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 50 / 150), ((0, 0, 10, 10), (2, 2, 8, 8), 0.36), ((3, 3, 3, 3), (3, 3, 3, 3), 0.0)],
)
def test_iou(spark, a, b, expected):
    x, y = (tuple(F.lit(v) for v in box) for box in (a, b))
    assert one(spark, geometry.iou(x, y)) == pytest.approx(expected)
    assert one(spark, geometry.iou(y, x)) == pytest.approx(expected)
    assert tracking.overlap(a, b) == pytest.approx(expected)


def test_expand_and_clamp(spark):
    def grown(box, margin, width, height):
        return one(spark, geometry.clamp_box(geometry.expand_box(tuple(F.lit(v) for v in box), margin), F.lit(width), F.lit(height)))

    assert tuple(grown((100, 100, 200, 150), 0.2, 1000, 1000)) == (80, 90, 220, 160)
    assert tuple(grown((100, 100, 200, 150), 0.0, 1000, 1000)) == (100, 100, 200, 150)
    assert tuple(grown((0, 0, 20, 20), 1.0, 1000, 1000)) == (0, 0, 40, 40)
    assert grown((5, 5, 5, 5), 0.0, 10, 10) is None
    assert grown((30, 30, 10, 10), 0.0, 10, 10) is None
    assert tuple(grown((-5, -5, 50, 50), 0.0, 10, 12)) == (0, 0, 10, 12)


TEMPLATE = [[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]]


def test_frontal_from_landmarks(spark):
    def score(points):
        rows = spark.createDataFrame([(points,)], "lm array<array<double>>")
        return rows.select(frontal.frontal_from_landmarks("lm").alias("x")).first().x

    c, s = 2 * math.cos(0.5), 2 * math.sin(0.5)
    turned = [[c * x - s * y, s * x + c * y] for x, y in TEMPLATE]
    assert score(TEMPLATE) > 0.95
    assert score(turned) == pytest.approx(score(TEMPLATE), abs=1e-6)
    assert score([[0.0, 0.0], [10.0, 0.0], [10.0, 5.0], [9.0, 10.0], [10.0, 10.0]]) < 0.2
    assert score(None) == 1.0
    assert score(TEMPLATE[:3]) == 1.0
    assert score([[1.0, 1.0], [1.0, 1.0], *TEMPLATE[2:]]) == 0.0


def test_frontal_from_eyes(spark):
    def score(centres, width=100):
        eyes = [(int(x) - 2, 0, int(x) + 2, 4, s) for x, s in centres]
        rows = spark.createDataFrame([(eyes, width)], "eyes array<struct<x1:int,y1:int,x2:int,y2:int,score:double>>, width int")
        return rows.select(frontal.frontal_from_eyes("eyes", "width").alias("x")).first().x

    good = score([(28, 0.9), (72, 0.9)])
    assert good > 0.95
    assert score([(46, 0.9), (62, 0.9)]) < good / 2
    assert 0 < score([]) < score([(50, 0.9)]) < 0.5
    assert score([(28, 0.9), (72, 0.9), (50, 0.1)]) == good
    assert score([(28, 0.9), (72, 0.9)], 0) > 0


def test_cosine_difference(spark):
    def diff(a, b):
        return one(spark, geometry.cosine_difference(F.lit(a), F.lit(b)))

    assert diff([1.0, 0.0], [2.0, 0.0]) == pytest.approx(0.0)
    assert diff([1.0, 0.0], [0.0, 3.0]) == pytest.approx(1.0)
    assert diff([0.0, 0.0], [0.0, 3.0]) == pytest.approx(1.0)


# -- gates --------------------------------------------------------------------------------------


def test_quality_gate_bounds_are_inclusive_and_null_blur_is_zero(spark):
    rows = [(1, 0.5, 0, 45, 50.0), (2, 0.49, 0, 45, 50.0), (3, 0.5, 0, 44, 50.0), (4, 0.5, 0, 45, None), (5, None, 0, 45, 60.0)]
    d = spark.createDataFrame(rows, "id int, confidence double, y1 int, y2 int, blur_var double").withColumn("num_eyes", F.lit(1)).withColumn("frontal", F.lit(0.5)).withColumn("frame_height", F.lit(1000))
    assert [r.kept for r in gates.detection_records(d, Config()).orderBy("id").collect()] == [True, False, False, False, False]
    assert not gates.detection_records(d, Config(require_eyes=2)).filter("kept").count()
    assert not gates.detection_records(d, Config(min_frontal_score=0.6)).filter("kept").count()


def test_short_tracks_are_dropped_below_the_bound_only(spark):
    t = tracks(spark, [(0.0, 1.2, 1), (0.0, 1.1, 2)])
    assert [r.track_id for r in gates.drop_short_tracks(t, 1.2).collect()] == [1]
    assert gates.drop_short_tracks(t, 0).count() == 2


def test_non_max_suppression(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1.0, 0.0, 11.0, 10.0, 0.8), (1, 20.0, 0.0, 30.0, 10.0, 0.1), (2, 1.0, 0.0, 11.0, 10.0, 0.8)]
    b = spark.createDataFrame(rows, "frame int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted((r.frame, r.score) for r in gates.non_max_suppression(b, ["frame"]).collect()) == [(1, 0.1), (1, 0.9), (2, 0.8)]


# -- tracks -------------------------------------------------------------------------------------


def detections(spark, rows):
    """Rows (frame, box, label)."""
    made = [("v", f, f * 0.3, *box, 0.9, label, 100.0, 1.0) for f, box, label in rows]
    return spark.createDataFrame(made, "video string, frame_index int, time double, x1 int, y1 int, x2 int, y2 int, confidence double, label string, blur_var double, frontal double")


BOX = (0, 0, 100, 100)


@pytest.mark.parametrize(
    ("rows", "cut_frames", "expected"),
    [
        ([(0, BOX, "a"), (1, (5, 5, 105, 105), "a")], [], 1),
        ([(0, BOX, "a"), (1, (500, 500, 600, 600), "a")], [], 2),
        ([(0, BOX, "a"), (2, BOX, "a")], [], 1),
        ([(0, BOX, "a"), (3, BOX, "a")], [], 2),
        ([(0, BOX, "a"), (1, BOX, "a")], [1], 2),
        ([(0, BOX, "a"), (2, BOX, "a")], [1], 2),
        ([(0, BOX, "cat"), (0, BOX, "dog"), (1, BOX, "cat"), (1, BOX, "dog")], [], 2),
    ],
)
def test_box_tracker(spark, rows, cut_frames, expected):
    frames = spark.createDataFrame([("v", f, f in cut_frames) for f in range(5)], "video string, frame_index int, is_cut boolean")
    found = tracking.tracks_of(tracking.track_boxes(detections(spark, rows), Config(), frames)).collect()
    assert len(found) == expected
    if rows == [(0, BOX, "a"), (1, (5, 5, 105, 105), "a")]:
        assert (found[0].start_time, found[0].end_time, found[0].num_detections) == (0.0, 0.3, 2)


def test_stream_tracker_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for f in range(40):
        for k in range(3):
            if rng.random() < 0.8:
                x = 60 * k + f * (k - 1) + rng.randrange(4)
                rows.append((f, (x, 0, x + 50, 50), "a"))
    every = detections(spark, rows).withColumn("is_cut", F.col("frame_index").isin(11, 25))
    for k, (lo, hi) in enumerate([(0, 13), (13, 30), (30, 40)]):
        every.filter((F.col("frame_index") >= lo) & (F.col("frame_index") < hi)).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    from quorumscan.streaming.tracker import stream_tracks

    source = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(*[f"{tmp_path}/in/*"])
    q = stream_tracks(source, Config()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    columns = ["frame_index", "x1", "track_id"]
    batch = tracking.track_boxes(every, Config()).select(columns).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect())) == sorted(map(tuple, batch))


def board(spark, rows, k, gap=0, weight=0.0):
    """Frames kept of rows (frame, blur, confidence, frontal), best first."""
    s = spark.createDataFrame([(1, *r) for r in rows], "track int, frame int, blur double, confidence double, frontal double")
    score = frontal.representative_score(F.col("blur"), F.col("confidence"), F.col("frontal"), weight)
    return [r.frame for r in tracking.spaced_representatives(s, ["track"], score, "frame", k, gap).orderBy("rank").collect()]


def test_boards(spark):
    blur = [(f, b, 1.0, 1.0) for f, b in enumerate((10.0, 90.0, 50.0, 1.0))]
    assert board(spark, blur, 2) == [1, 2]
    two = [(0, 100.0, 1.0, 0.1), (1, 90.0, 1.0, 1.0)]
    assert board(spark, two, 1) == [0]
    assert board(spark, two, 1, weight=1.0) == [1]
    assert board(spark, [(0, 500.0, 1.0, 0.6), (1, 50.0, 1.0, 1.0)], 1, weight=1.0) == [0]
    assert board(spark, [(3, 5.0, 1.0, 1.0), (1, 5.0, 1.0, 1.0), (2, None, 1.0, 1.0)], 1) == [1]
    near = [(f, 10.0 + f, 1.0, 1.0) for f in (0, 1, 2)]
    assert board(spark, near, 3, gap=10) == [2]
    assert sorted(board(spark, [(0, 10.0, 1.0, 1.0), (1, 11.0, 1.0, 1.0), (20, 5.0, 1.0, 1.0)], 3, gap=10)) == [1, 20]


def test_sessions_split_where_more_than_the_gap_has_passed(spark):
    e = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 20.1), ("b", 5.0)], "who string, t double")
    assert [tuple(r) for r in tracking.sessionise(e, ["who"], "t", 10.0).orderBy("who", "t").collect()] == [("a", 0.0, 0), ("a", 10.0, 0), ("a", 20.1, 1), ("b", 5.0, 0)]


# -- identity -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pairs", "n", "threshold", "expected"),
    [({}, 0, 0.2, []), ({}, 1, 0.2, [0]), ({(0, 1): 0.5}, 2, 0.2, [0, 1]), ({(0, 1): 0.2}, 2, 0.2, [0, 1]), ({(0, 1): 0.1, (1, 2): 0.1, (0, 2): 0.5}, 3, 0.2, [0, 0, 1]), ({(0, 1): 0.05, (0, 2): 0.9, (0, 3): 0.9, (1, 2): 0.9, (1, 3): 0.9, (2, 3): 0.9}, 4, 0.2, [0, 0, 1, 2])],
)
def test_complete_linkage(pairs, n, threshold, expected):
    m = np.zeros((n, n))
    for (i, j), d in pairs.items():
        m[i, j] = m[j, i] = d
    assert identity.complete_linkage(m, threshold) == expected


def test_median_of_crop_differences(spark):
    rows = [("v", 1, [1.0, 0.0]), ("v", 1, [1.0, 0.0]), ("v", 1, [0.0, 1.0]), ("v", 2, [0.0, 1.0])]
    crops = spark.createDataFrame(rows, "video string, track_id int, feature array<double>")
    (r,) = identity.crop_differences(crops, ["video"]).collect()
    assert (r.i, r.j) == (1, 2)
    assert r["diff"] == pytest.approx(1.0)


def test_tracks_without_crops_have_no_character_and_window_scope_recounts(spark):
    far = 0.9
    d = {(1, 2): 0.1, (1, 3): far, (1, 4): 0.3, (2, 3): far, (2, 4): 0.3, (3, 4): far}
    diffs = spark.createDataFrame([("v", i, j, x) for (i, j), x in d.items()], "video string, i int, j int, diff double")
    t = tracks(spark, [(0, 1, None)] * 5)
    known = {r.track_id: r.character_id for r in identity.assign_characters(t, diffs, 0.2).collect()}
    assert known == {1: 0, 2: 0, 3: 1, 4: 2, 5: None}
    members = spark.createDataFrame([("v", 0, i) for i in (1, 2, 3, 4)] + [("v", 1, i) for i in (1, 2)] + [("v", 2, 4), ("v", 3, 5)], "video string, k long, track_id int")
    assert {r.k: r.n for r in identity.window_scope_counts(members, diffs, 0.2).collect()} == {0: 3, 1: 1, 2: 1, 3: 0}


# -- joins by time ------------------------------------------------------------------------------


def test_overlap_join_gives_the_pairs_of_a_nested_loop(spark):
    rng = random.Random(1)
    starts = [rng.choice([rng.uniform(0, 50), float(rng.randrange(50))]) for _ in range(40)]
    spans = [(a, a + rng.choice([0.0, 5.0, rng.uniform(0, 30)])) for a in (float(rng.randrange(50)) for _ in range(60))]
    w = spark.createDataFrame([("v", k, t) for k, t in enumerate(starts)], "video string, k int, t double")
    found = overlap.overlap_join(w, tracks(spark, [(a, b, 1) for a, b in spans]), W).select("k", "track_id").collect()
    assert sorted(map(tuple, found)) == sorted((k, i + 1) for k, t in enumerate(starts) for i, (a, b) in enumerate(spans) if a < t + W and b >= t)


@pytest.mark.parametrize(("prev", "time", "tolerance", "expected"), [(5.1, 6.0, 0.1, False), (5.1, 6.0, 0.11, True), (4.0, 4.9, 0.1, True), (4.0, 4.8, 0.1, False)])
def test_cut_between(spark, prev, time, tolerance, expected):
    samples = spark.createDataFrame([("v", 0, prev), ("v", 1, time)], "video string, frame_index int, time double")
    assert [r.is_cut for r in overlap.cut_between(samples, cuts(spark, [5.0]), tolerance).orderBy("frame_index").collect()] == [False, expected]


def test_nearest_cut_prefers_the_earlier_of_two_as_near(spark):
    points = spark.createDataFrame([("v", t) for t in (4.4, 5.9, 7.0, 12.0)], "video string, t double")
    near = {r.t: r.cut for r in overlap.nearest_cut(points, cuts(spark, [5.0, 9.0]), 2.0).collect()}
    assert near == {4.4: 5.0, 5.9: 5.0, 7.0: 5.0, 12.0: None}
    assert {r.cut for r in overlap.nearest_cut(points, cuts(spark, [5.0]), 0).collect()} == {None}
    assert {r.t: r.cut for r in overlap.nearest_cut(points, cuts(spark, [5.0]), 1.5).collect()}[7.0] is None


def test_characters_per_shot(spark):
    t = tracks(spark, [(0, 1, 1), (5, 6, 2), (11, 12, 1), (25, 26, 3), (26, 27, 4)])
    assert [r.n for r in overlap.characters_per_shot(t, cuts(spark, [10, 20])).orderBy("shot").collect()] == [2, 1, 2]
    assert [r.n for r in overlap.characters_per_shot(tracks(spark, [(10, 11, 1)]), cuts(spark, [10])).orderBy("shot").collect()] == [0, 1]


# -- scan and selection -------------------------------------------------------------------------


def test_window_grid(spark):
    assert [r.t for r in windows.window_grid(videos(spark, 10), W, STEP).orderBy("k").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert windows.window_grid(videos(spark, 4), W, STEP).count() == 0
    assert [r.t for r in windows.cut_scan(videos(spark, 10), cuts(spark, [1.5, 8.0]), tracks(spark, [(0, 1, 1)]), W, STEP).collect()] == [1.5]
    assert {r.n for r in windows.window_scan(videos(spark, 10), tracks(spark, []), W, STEP).collect()} == {0}


def test_one_segment_with_its_members(spark):
    assert segments(spark, [(0, 0, 0), (1, 1, 1)], 10) == [(0.0, 5.0, 2, 0.0, [0, 1], [1, 2])]


@pytest.mark.parametrize(("rows", "duration"), [([(0, 0, 0), (1, 1, 0)], 10), ([(0, 0, 0), (1, 1, None)], 10), ([(0, 0, 0), (5, 5, 1)], 10), ([(0, 4, 0), (0, 4, 1)], 4.9)])
def test_no_segment(spark, rows, duration):
    assert segments(spark, rows, duration) == []


def test_segment_starts_where_the_count_is_reached(spark):
    (s,) = segments(spark, [(0, 2, 0), (6, 6, 1)], 12)
    assert (s[0], s[2]) == (2.0, 2)


def test_snapping(spark):
    both = [(0, 20, 0), (0, 20, 1)]
    assert segments(spark, both, 25, [1.5, 12])[0][:4] == (1.5, 6.5, 2, 0.0)
    assert segments(spark, [(0, 1, 0), (0, 20, 1)], 7, [1.5])[0][0] == 0.0  # the count would drop
    assert segments(spark, both, 6, [1.5])[0][0] == 0.0  # the window would pass the end
    assert segments(spark, [*both, (6, 6, 2)], 25, [1.5])[0][2:5] == (3, 0.0, [0, 1, 2])
    # Only the nearest cut is tried; a start may move behind the previous end unless that is forbidden.
    assert [s[0] for s in segments(spark, both, 20, [4.0])][:2] == [0.0, 4.0]
    assert [s[0] for s in segments(spark, both, 20, [4.0], strict=True)][:2] == [0.0, 5.0]


def greedy(counts, x):
    """The walk over a scan in plain Python."""
    k, out = 0, []
    while k < len(counts):
        if counts[k] >= x:
            out.append(k)
            k = math.ceil((k * STEP + W) / STEP - 1e-9)
        else:
            k += 1
    return out


def test_replay_of_one_scan_for_any_threshold(spark):
    rng = random.Random(3)
    counts = [[rng.randrange(6) for _ in range(rng.randrange(1, 60))] for _ in range(8)]
    scan = spark.createDataFrame([(str(v), k, k * STEP, n) for v, c in enumerate(counts) for k, n in enumerate(c)], "video string, k long, t double, n long")
    for x in (1, 3, 5, 9):
        found = selection.replay(scan, x, W, STEP).collect()
        assert sorted((r.video, r.k) for r in found) == sorted((str(v), k) for v, c in enumerate(counts) for k in greedy(c, x))


def test_screen_time(spark):
    t = spark.createDataFrame([("v", 1, 0.0, 1.0, 2, 7), ("v", 2, 0.0, 1.0, 2, 7), ("v", 3, 0.0, 0.0, 1, 8)], TRACKS)

    def counted(least):
        return windows.window_scan(videos(spark, 5), t, W, 0.3, least).orderBy("k").first().n

    assert (counted(0.0), counted(0.3), counted(1.0), counted(1.3)) == (2, 2, 1, 0)


def test_sensitivity_and_curve(spark):
    scan = spark.createDataFrame([("v", k, float(k), n) for k, n in enumerate([1, 4, 2, 9, 4])], "video string, k long, t double, n long")
    assert {r.x: (r.hits, r.share) for r in windows.sensitivity(scan, [2, 5]).collect()} == {2: (4, 0.8), 5: (1, 0.2)}
    assert [r.n for r in windows.curve(scan, 200).orderBy("bucket").collect()] == [1, 4, 2, 9, 4]
    assert [r.n for r in windows.curve(scan, 2).orderBy("bucket").collect()] == [4, 9]


def test_whole_analysis_and_sweep(spark):
    a, b = (0, 0, 100, 100), (300, 0, 400, 100)
    d = detections(spark, [(f, box, "face") for f in range(4) for box in (a, b)]).withColumn("frame_height", F.lit(1000)).withColumn("num_eyes", F.lit(2))
    diffs = spark.createDataFrame([("v", 0, 1, 0.9)], "video string, i int, j int, diff double")
    c = Config(window_seconds=0.6, frame_interval=0.3, min_events_per_window=2, identity_threshold=0.2, clip_snap_max_shift=0.0)
    for scope in ("window", "video"):
        from dataclasses import replace

        found = analyze(d, cuts(spark, []), diffs, videos(spark, 1.2), replace(c, cluster_scope=scope))
        assert [(r.k, r.character_count) for r in found.segments().orderBy("k").collect()] == [(0, 2), (2, 2)]
    grid = sweep(found.tracks, diffs, videos(spark, 1.2), c, [0.2, 0.95], [1, 2])
    assert sorted((r.threshold, r.x, r.n_characters, r.n_segments) for r in grid.collect()) == [(0.2, 1, 2, 2), (0.2, 2, 2, 2), (0.95, 1, 1, 2), (0.95, 2, 1, 0)]


# -- evaluation and catalog ---------------------------------------------------------------------


def test_metrics(spark):
    def recall(p, g):
        return one(spark, metrics.recall(F.lit(p), F.lit(g)))

    assert [recall(3, 9), recall(9, 9), recall(20, 9), recall(0, 0)] == pytest.approx([1 / 3, 1, 1, 1])
    assert one(spark, metrics.count_f1(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, metrics.count_f1(F.lit(3), F.lit(9))) == pytest.approx(0.5)
    assert one(spark, metrics.count_ratio(F.lit(3), F.lit(0))) is None


def test_truth_from_names(spark):
    def parsed(name):
        return evaluation.parse_truth(spark.createDataFrame([(name,)], "path string"), {"魔女之旅": "2d"}).collect()

    (r,) = parsed("films/魔女之旅_760s（人脸数期望：2+5+1+0+3+1）（跨镜头身份去重后期望：9）.mp4")
    assert (r.shot_faces, r.total_faces, r.num_characters, r.num_shots, r["style"], r.title, r.source_offset) == ([2, 5, 1, 0, 3, 1], 12, 9, 6, "2d", "魔女之旅", 760)
    assert parsed("plain.mp4") == []
    with pytest.raises(Exception, match="incomplete annotation"):
        parsed("x（人脸数期望：2+5）.mp4")


def test_run_summary_takes_the_upper_median_and_its_own_window(spark):
    runs = spark.createDataFrame([("a", 1420.0, 30.0, [9, 4, 7, 19]), ("b", 95.0, 30.0, []), ("c", 300.0, 15.0, [1])], "name string, duration double, window_seconds double, counts array<int>")
    got = {r.name: (r.max_windows, r.median_count, r.max_count) for r in evaluation.run_summary(runs).collect()}
    assert got == {"a": (47, 9, 19), "b": (3, 0, 0), "c": (20, 1, 1)}


def test_best_threshold_ties(spark):
    g = spark.createDataFrame([(0.1, 0.9), (0.2, 0.9), (0.3, 0.5)], "threshold double, f1 double")
    assert evaluation.best_threshold(g, []).first().threshold == 0.1
    assert evaluation.best_threshold(g, [], prefer="highest").first().threshold == 0.2


def test_style_votes_and_evidence(spark):
    v = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("b", False)], "film string, is_3d boolean")
    assert {r.film: r["style"] for r in evaluation.majority_style(v, "film").collect()} == {"a": "2d", "b": "3d"}
    d = spark.createDataFrame([("a", "anime", 1.0), ("a", "real", 2.0), ("b", "anime", 1.0)], "film string, by string, c double")
    got = {r.film: (r.ratio, r.is_real, r.is_ambiguous) for r in evaluation.evidence_ratio(d, "film", "by", "c", "anime", "real").collect()}
    assert got == {"a": (0.5, False, True), "b": (math.inf, False, False)}


def test_status_rollup_names_and_progress(spark):
    s = spark.createDataFrame([(1, "queued"), (1, "failed"), (2, "cancelled"), (2, "cancelled"), (3, "failed"), (3, "done"), (4, "cancelled"), (4, "done")], "task int, status string")
    assert {r.task: r.status for r in catalog.status_rollup(s, "task").collect()} == {1: "running", 2: "cancelled", 3: "failed", 4: "done"}
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "pos int, stem string")
    assert [r.unique_name for r in catalog.distinct_names(n, [], "stem", "pos").orderBy("pos").collect()] == ["a", "b", "a_2", "a_3"]
    p = spark.createDataFrame([("cuts", 0.5), ("scan", 2.0), ("identity", -1.0), ("select", 1.0)], "stage string, fraction double")
    assert [r.percent for r in catalog.progress_percent(p).collect()] == [5, 85, 85, 100]


def test_assets_keep_what_a_push_leaves_null(spark):
    a = spark.createDataFrame([(1, "idle", 5), (2, "idle", 6)], "asset_id int, status string, n int")
    s = spark.createDataFrame([(1, "done", None), (9, "done", 1)], "asset_id int, status string, n int")
    assert sorted(map(tuple, catalog.apply_state(a, s).collect())) == [(1, "done", 5), (2, "idle", 6)]


def test_config_precedence():
    c = Config(identity_threshold=0.5)
    assert c.with_style("2d").identity_threshold == 0.20
    assert c.with_style("unknown") == c
    assert c.with_frontal_weight(0.7).with_style("real").frontal_weight == 0.7
    assert Config(identity_threshold=None, embedder="arcface").threshold() == 0.6


# -- sources and text ---------------------------------------------------------------------------


@pytest.mark.parametrize(("interval", "limit", "expected"), [(0.5, None, [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5]), (0.01, None, [k / 10 for k in range(50)]), (0.5, 2.0, [0.0, 0.5, 1.0, 1.5])])
def test_sampled_frames(spark, interval, limit, expected):
    frames = spark.range(50).select(F.lit("v").alias("video"), F.col("id").alias("raw_index"), F.lit(10.0).alias("fps"))
    assert [r.time for r in media.sampled_frames(frames, interval, limit).orderBy("raw_index").collect()] == pytest.approx(expected)


def test_cut_log_and_containers(spark, tmp_path):
    (tmp_path / "v1").write_text("x lavfi.scd.time: 3.25 y\nnothing\nlavfi.scd.time:1\n")
    assert sorted(r.cut for r in media.read_cut_log(spark, str(tmp_path)).collect()) == [1.0, 3.25]
    p = spark.createDataFrame([("a", "h264", "mov,mp4", 1.0), ("b", None, "mp4", 1.0), ("c", "hevc", "mp4", 1.0), ("d", "h264", "avi", 1.0), ("e", "h264", "mp4", None)], "video string, codec string, container string, duration double")
    assert [r.problem for r in media.valid_containers(p).orderBy("video").collect()] == [None, "no video stream", "codec hevc", "container avi", "no duration"]


def test_scan_round_trip_serves_replay(spark, tmp_path):
    from quorumscan.sinks import write_report, write_scan

    scan = windows.window_scan(videos(spark, 10), tracks(spark, [(0, 3, 1), (2, 8, 2)]), W, STEP)
    write_scan(scan, f"{tmp_path}/scan")
    back = spark.read.parquet(f"{tmp_path}/scan").withColumn("video", F.col("video").cast("string"))
    assert sorted(map(tuple, selection.replay(back, 2, W, STEP).collect())) == sorted(map(tuple, selection.replay(scan, 2, W, STEP).collect()))
    write_report(scan, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 6


def test_registry():
    r = media.Registry()
    r.register("one")(lambda: object())
    assert r.get("one") is r.get("one")
    with pytest.raises(ValueError, match="already"):
        r.register("one")(lambda: None)
    with pytest.raises(KeyError):
        r.get("two")


def test_text(spark):
    names = {"a/b/My film.mp4": "My film", "x/a:b*c.mp4": "a_b_c", ".hidden": "hidden", "": "video", " .. ": "video"}
    for name, expected in names.items():
        assert one(spark, text.safe_stem(F.lit(name))) == expected
    assert one(spark, text.stamp(F.lit(65.9))) == "01m05s"
    assert one(spark, text.clock(F.lit(65.5))) == "01:06"
    assert one(spark, text.parse_numbers(F.lit("0.1, ,2"))) == [0.1, 2.0]
    assert text.display_width("a人") == 3
    assert text.padded("人a", 4) == " 人a"
    assert text.padded("abcdef", 3) == "def"
