"""Styles as columns, raw detector levels, hooks, scopes and lists: small cases by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumscan.config import PROFILES, Config
from quorumscan.functions import text
from quorumscan.operators import anchors, catalog, evaluation, style
from quorumscan.plans.pipeline import analyze, analyze_styles
from quorumscan.sources import media


def test_styles_are_looked_up_forced_or_left_alone(spark):
    videos = spark.createDataFrame([("a", "2d"), ("b", "real"), ("c", "odd"), ("d", None)], "video string, style string")
    config = Config(identity_threshold=None, crop_margin=0.3)

    def settings(c):
        return {r.video: (r.detector, r.identity_threshold, r.crop_margin, r.min_face_height_ratio) for r in style.styled(videos, c).collect()}

    own = (config.detector, 0.178, 0.3, 0.045)
    assert settings(config) == {"a": ("anime_face_imgutils", 0.20, 0.6, 0.03), "b": ("real_face_scrfd", 0.85, 0.0, 0.09), "c": own, "d": own}
    assert set(settings(Config(style_routing=False)).values()) == {("anime_face_imgutils", 0.178, 0.0, 0.045)}
    assert set(settings(Config(force_style="3d", style_routing=False)).values()) == {("real_face_scrfd", 0.85, 0.0, 0.045)}
    assert style.styled(videos, config.with_frontal_weight(0.5)).agg(F.min("frontal_weight")).first()[0] == 0.5
    assert style.style_profiles(spark, config).count() == len(PROFILES)


def test_mixed_styles_in_one_plan_equal_one_analysis_each(spark):
    rows = [(v, f, f * 1.0, "face", 10 * k, 0, 10 * k + 40, h, 0.9, 80.0, 1000) for v in "abc" for f in range(8) for k, h in ((0, 35), (10, 60), (20, 95))]
    detections = spark.createDataFrame(rows, "video string, frame_index int, time double, label string, x1 int, y1 int, x2 int, y2 int, confidence double, blur_var double, frame_height int")
    apart = [(v, i, j, d) for v in "abc" for i, j, d in ((0, 1, 0.19), (0, 2, 0.8), (1, 2, 0.8))]
    differences = spark.createDataFrame(apart, "video string, i int, j int, diff double")
    films = spark.createDataFrame([("a", 8.0, "2d"), ("b", 8.0, "real"), ("c", 8.0, None)], "video string, duration double, style string")
    cuts = spark.createDataFrame([], "video string, cut double")
    config = Config(window_seconds=4.0, frame_interval=1.0)
    mixed = analyze_styles(detections, cuts, differences, films, config)
    columns = ["video", "track_id", "start_time", "num_detections", "character_id"]
    found = sorted(map(tuple, mixed.tracks.select(columns).collect()))
    scans = sorted(map(tuple, mixed.window_scan.select("video", "t", "n").collect()))
    want, want_scans = [], []
    for video, kind in (("a", "2d"), ("b", "real"), ("c", None)):
        one = analyze(*(df.filter(F.col("video") == video) for df in (detections, cuts, differences, films)), config.with_style(kind))
        want += map(tuple, one.tracks.select(columns).collect())
        want_scans += map(tuple, one.window_scan.select("video", "t", "n").collect())
    assert found == sorted(want)
    assert scans == sorted(want_scans)
    assert {r[0]: sum(1 for x in found if x[0] == r[0]) for r in found} == {"a": 3, "b": 1, "c": 2}


def level(spark, size, stride, boxes, frame="f", width=640, height=320):
    """A level with nothing but ``boxes`` {anchor: (score, distances, landmarks)}."""
    n = (size // stride) ** 2 * 2
    scores, distances, landmarks = np.zeros(n), np.zeros((n, 4)), np.zeros((n, 10))
    for at, (score, d, k) in boxes.items():
        scores[at], distances[at], landmarks[at] = score, d, k
    row = (frame, width, height, scores.tolist(), distances.ravel().tolist(), landmarks.ravel().tolist())
    return spark.createDataFrame([row], "frame string, width int, height int, scores array<double>, distances array<double>, landmarks array<double>")


def test_levels_are_masked_decoded_rescaled_and_thinned(spark):
    # Stride 16 has 40 x 40 cells; cell (3, 2) is number 83, its second anchor 167.  The frame is twice the input's side.
    points = [1, 1, 2, 1, 1.5, 2, 1, 3, 2, 3]
    coarse = {167: (0.9, [1, 1, 2, 3], points), 10: (0.49, [1, 1, 1, 1], points)}
    # On stride 8 the same face with a lower score, and another one elsewhere.
    fine = {2 * (80 * 4 + 6): (0.8, [2, 2, 4, 6], points), 2 * (80 * 40 + 40): (0.5, [1, 1, 1, 1], points)}
    levels = {8: level(spark, 640, 8, fine, width=1280), 16: level(spark, 640, 16, coarse, width=1280), 32: level(spark, 640, 32, {}, width=1280)}
    raw = anchors.all_levels(levels, ["frame"], 0.5)
    assert sorted((r.stride, r.at, r.order) for r in raw.collect()) == [(8, 652, 652), (8, 6480, 6480), (16, 167, 12800 + 167)]
    rows = {r.confidence: r for r in anchors.detections_of(levels, ["frame"], 0.5).collect()}
    assert set(rows) == {0.9, 0.5}
    best = rows[0.9]
    assert (best.x1, best.y1, best.x2, best.y2, best.label) == (64, 32, 160, 160, "face")
    assert best.landmarks[0] == [128.0, 96.0]
    assert best.landmarks[2] == [144.0, 128.0]
    assert (rows[0.5].x1, rows[0.5].y1) == (624, 624)


def test_equal_scores_go_to_the_earlier_anchor_and_boxes_are_cut_off_towards_zero(spark):
    same = {0: (0.7, [0.55, 0.55, 4, 4], [0] * 10), 1: (0.7, [0.5, 0.5, 4, 4], [0] * 10)}
    (r,) = anchors.detections_of({32: level(spark, 640, 32, same)}, ["frame"], 0.5).collect()
    assert (r.x1, r.y1, r.x2, r.y2) == (-17, -17, 128, 128)
    empty = level(spark, 640, 32, {})
    assert anchors.detections_of({32: empty}, ["frame"], 0.5).collect() == []
    nothing = empty.withColumn("scores", F.array().cast("array<double>"))
    assert anchors.detections_of({32: nothing}, ["frame"], 0.5).collect() == []


def test_hooks_are_neutral_unless_a_detector_has_its_own(spark, monkeypatch):
    marks = [[10.0, 0.0], [30.0, 0.0], [20.0, 10.0], [12.0, 20.0], [28.0, 20.0]]
    rows = [("anime_face_imgutils", 90, 5, 110, 25, marks), ("real_face_scrfd", 90, 5, 110, 25, marks), ("mine", 200, 5, 210, 25, None)]
    boxes = spark.createDataFrame(rows, "detector string, x1 int, y1 int, x2 int, y2 int, landmarks array<array<double>>").withColumn("frame_width", F.lit(100)).withColumn("frame_height", F.lit(50))
    monkeypatch.setitem(media.hooks, "mine", media.Hooks(frontal=lambda: F.lit(0.25)))
    found = {r.detector: (r.crop and tuple(r.crop), r.frontal) for r in media.with_hooks(boxes, 0.5).collect()}
    assert found == {"anime_face_imgutils": ((80, 0, 100, 35), 1.0), "real_face_scrfd": ((80, 0, 100, 35), 1.0), "mine": (None, 0.25)}
    assert media.default_threshold("arcface") == 0.6
    with pytest.raises(KeyError):
        media.default_threshold("none")


def test_scopes(spark):
    films = spark.createDataFrame([("a", 10, 5, 4), ("b", 0, 0, None)], "title string, max_windows int, segments_video int, segments_window int")
    assert {tuple(r) for r in evaluation.scope_totals(films, ["video", "window"]).collect()} == {("video", 5, 10, 50.0), ("window", 4, 10, 40.0)}
    shares = {(r.title, r.scope): r.percent for r in evaluation.film_shares(films, ["title"], ["video", "window"]).collect()}
    assert shares == {("a", "video"): 50.0, ("a", "window"): 40.0, ("b", "video"): 0.0, ("b", "window"): None}
    counted = spark.createDataFrame([(4, 4, 2, None), (2, 3, 2, 1), (0, 0, 1, 0)], "truth int, pred_video int, pred_window int, pred_clip int")
    rows = {r.scope: r for r in evaluation.scope_macro(counted, ["video", "window", "clip"]).collect()}
    assert rows["video"].macro_recall == 1.0
    assert rows["video"].macro_f1 == pytest.approx((1 + 0.8 + 1) / 3)
    assert rows["video"].mean_ratio == pytest.approx((1 + 1.5) / 2)
    assert (rows["clip"].n, rows["window"].macro_recall) == (2, pytest.approx((0.5 + 1 + 1) / 3))


def test_lists_and_labels(spark):
    films = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "title string, created int")
    assert [r.title for r in catalog.in_order_of_creation(films, "created").collect()] == ["c", "b", "a"]
    assert {r.title for r in catalog.of_titles(films, ["a", "x"]).collect()} == {"a"}
    assert catalog.of_titles(films, None).count() == 3
    styles = spark.createDataFrame([("2d",), ("3d",), ("real",), ("x",), (None,)], "s string")
    assert [r.x for r in styles.select(text.style_label(F.col("s")).alias("x")).collect()] == ["2D", "3D CG", "真人", "—", "—"]
    (r,) = spark.range(1).select(text.percent_of(F.lit(30.0), F.lit(900.0)).alias("x"), text.percent_of(F.lit(1.0), F.lit(0.0)).alias("y")).collect()
    assert (r.x, r.y) == ("3.33%", None)


def test_reports_round_the_exact_value(spark):
    from quorumscan import sinks

    values = [2.675, 0.0005, 1.0005, 0.5, None, -2.675]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    found = [tuple(r) for r in rows.select("k", sinks.rounded("x", 2).alias("two"), sinks.rounded("x", 3).alias("three")).orderBy("k").collect()]
    assert found == [(k, None if v is None else round(v, 2), None if v is None else round(v, 3)) for k, v in enumerate(values)]
    assert found[0][1] == 2.67


def test_detections_are_written_with_what_was_dropped(spark, tmp_path):
    from quorumscan import sinks

    rows = [("v", 1, 0.12345, 0.98765, 51.239, False), ("v", 0, 0.0, 0.5, 2.675, True), ("w", 0, 0.0, 0.5, 1.0, True)]
    df = spark.createDataFrame(rows, "video string, frame_index int, time double, confidence double, blur_var double, kept boolean")
    sinks.write_detections(df, f"{tmp_path}/d")
    back = spark.read.json(f"{tmp_path}/d").orderBy("video", "frame_index").select("video", "frame_index", "time", "confidence", "blur_var", "kept").collect()
    assert [tuple(r) for r in back] == [("v", 0, 0.0, 0.5, 2.67, True), ("v", 1, 0.123, 0.9877, 51.24, False), ("w", 0, 0.0, 0.5, 1.0, True)]


def test_scans_in_rows_replay_as_stored_ones(spark, tmp_path):
    from quorumscan import sinks
    from quorumscan.operators import selection, windows

    tracks = spark.createDataFrame([("v", k, float(k), float(k + 6), 7, k % 4) for k in range(12)] + [("w", 0, 1.0, 2.0, 2, 0)], "video string, track_id int, start_time double, end_time double, num_detections int, character_id int")
    videos = spark.createDataFrame([("v", 20.0), ("w", 9.0)], "video string, duration double")
    cuts = spark.createDataFrame([("v", 4.4), ("v", 11.0)], "video string, cut double")
    scan, at_cuts = windows.window_scan(videos, tracks, 5.0, 1.0), windows.cut_scan(videos, cuts, tracks, 5.0, 1.0)
    sinks.write_scans(f"{tmp_path}/scans", videos, scan, cuts, at_cuts)
    t = media.read_scans(spark, f"{tmp_path}/scans")
    columns = ["video", "k", "start", "character_count"]
    for x in (1, 3):
        rows = selection.replay(t["scan"], x, 5.0, 1.0, videos=t["videos"], cuts=t["cuts"], at_cuts=t["at_cuts"], max_shift=2.0).select(columns)
        stored = media.parse_scans(sinks.stored_scans(videos, scan, cuts, at_cuts, 5.0, 1.0))
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, selection.replay_stored(stored, x, 5.0, 1.0, 2.0).select(columns).collect())) != []


def test_pictures_with_names_of_any_script(spark, tmp_path):
    folder = tmp_path / "片名"
    folder.mkdir()
    (folder / "顔.jpg").write_bytes(b"\xff\xd8data")
    (r,) = media.pictures(spark, str(tmp_path)).collect()
    assert bytes(r.content) == b"\xff\xd8data"
    (folder / "empty.jpg").write_bytes(b"")
    assert media.pictures(spark, str(tmp_path)).count() == 1


def test_style_is_routed_by_votes_then_evidence(spark):
    votes = [("flat", True), ("flat", False), ("cg", True), ("film", True), ("film", True), ("film", False), ("none", True)]
    evidence = [("cg", "anime_face_imgutils", 0.6), ("cg", "real_face_scrfd", 1.0), ("film", "anime_face_imgutils", 0.4), ("film", "real_face_scrfd", 1.0), ("flat", "real_face_scrfd", 5.0)]
    found = style.routed(spark.createDataFrame(votes, "video string, is_3d boolean"), spark.createDataFrame(evidence, "video string, detector string, confidence double"), Config())
    assert {r.video: (r["style"], r.ratio, r.is_ambiguous) for r in found.collect()} == {"flat": ("2d", None, False), "cg": ("3d", 0.6, True), "film": ("real", 0.4, False), "none": ("3d", float("inf"), False)}
    videos = spark.createDataFrame([("v", 160)], "video string, n_frames int")
    assert [r.frame_index for r in style.probes(videos, Config()).orderBy("frame_index").collect()] == [int(160 * (i + 0.5) / 16) for i in range(16)]


def test_an_analysis_ends_tracks_at_its_cuts(spark):
    rows = [("v", f, f * 1.0, "face", 0, 0, 40, 90, 0.9, 80.0, 1000) for f in range(6)]
    detections = spark.createDataFrame(rows, "video string, frame_index int, time double, label string, x1 int, y1 int, x2 int, y2 int, confidence double, blur_var double, frame_height int")
    differences = spark.createDataFrame([], "video string, i int, j int, diff double")
    films = spark.createDataFrame([("v", 8.0)], "video string, duration double")
    for times, want in (([], 1), ([2.5], 2), ([2.5, 4.5], 3), ([4.05], 3)):
        cuts = spark.createDataFrame([("v", t) for t in times], "video string, cut double")
        assert analyze(detections, cuts, differences, films, Config(window_seconds=4.0, frame_interval=1.0)).tracks.count() == want
