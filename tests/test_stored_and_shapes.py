"""Stored scans and strict walks, library bookkeeping, shapes and text as expressions."""

import json
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumscan import sinks
from quorumscan.functions import geometry, text
from quorumscan.operators import catalog, evaluation, selection
from quorumscan.sources import media

SEGMENT = "video string, k long, start double, character_count long, raw_start double, next_k long, raw_count long, raw_next_k long"


def test_strict_walk_keeps_the_grids_count(spark):
    rows = [("v", 0, 0.0, 6, 0.0, 5, 6, 5), ("v", 5, 4.0, 9, 5.0, 9, 7, 10), ("v", 9, 9.0, 8, 9.0, 14, 8, 14), ("v", 10, 10.0, 5, 10.0, 15, 5, 15)]
    chosen = spark.createDataFrame(rows, SEGMENT)
    got = selection.select_segments(chosen, 5.0, strict_non_overlap=True).orderBy("k").collect()
    assert [(r.k, r.start, r.character_count) for r in got] == [(0, 0.0, 6), (5, 5.0, 7), (10, 10.0, 5)]
    loose = selection.select_segments(chosen, 5.0).orderBy("k").collect()
    assert [(r.k, r.start, r.character_count) for r in loose] == [(0, 0.0, 6), (5, 4.0, 9), (9, 9.0, 8)]


@pytest.mark.parametrize("seed", range(3))
def test_strict_segments_never_overlap(spark, seed):
    rng = random.Random(seed)
    step, length, duration = 1.0, 4.0, 80.0
    windows = [(float(k), rng.randrange(8)) for k in range(77)]
    cuts = sorted(rng.uniform(0, duration) for _ in range(40))
    at_cuts = [(c, rng.randrange(8)) for c in cuts if c + length <= duration]
    value = json.dumps({"duration": duration, "frame_interval": step, "window_seconds": length, "cuts": cuts, "windows": [{"t": t, "n": n} for t, n in windows], "cut_windows": [{"t": t, "n": n} for t, n in at_cuts]})
    stored = media.parse_scans(spark.createDataFrame([("v", value)], "video string, value string"))
    for x in (2, 4, 6):
        got = selection.replay_stored(stored, x, length, step, 1.5, strict_non_overlap=True).orderBy("start").collect()
        counts = dict(windows) | dict(at_cuts)
        assert all(a.end <= b.start + 1e-9 for a, b in zip(got, got[1:]))
        assert all(r.character_count == counts[r.start] >= x and abs(r.snap_shift) <= 1.5 for r in got)


def test_scans_and_summaries_are_read_back(spark, tmp_path):
    videos = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "video string, duration double")
    scan = spark.createDataFrame([("a", 0, 0.0, 2), ("a", 1, 1.0, 3)], "video string, k long, t double, n long")
    cuts = spark.createDataFrame([("a", 4.5)], "video string, cut double")
    at_cuts = spark.createDataFrame([("a", 4.5, 3)], "video string, t double, n long")
    for r in sinks.stored_scans(videos, scan, cuts, at_cuts, 5.0, 1.0).collect():
        (tmp_path / r.video).mkdir()
        (tmp_path / r.video / "windows_scan.json").write_text(r.value)
    got = {r.video: r for r in media.read_stored_scans(spark, str(tmp_path)).collect()}
    assert (got["a"].cuts, [tuple(w) for w in got["a"].windows], [tuple(w) for w in got["a"].cut_windows]) == ([4.5], [(0.0, 2), (1.0, 3)], [(4.5, 3)])
    assert (got["b"].duration, got["b"].windows, got["b"].cuts) == (5.0, [], [])
    segments = spark.createDataFrame([("a", 4.5, 9.5, 3), ("a", 0.0, 5.0, 2)], "video string, start double, end double, character_count long")
    for r in sinks.run_summaries(segments, videos, 2, 5.0).collect():
        (tmp_path / r.video / "windows.json").write_text(r.value)
    got = media.read_run_summaries(spark, str(tmp_path)).collect()
    assert [(r.video, r.x, [s.start for s in r.segments]) for r in got] == [("a", 2, [0.0, 4.5]), ("b", 2, [])]
    tracks = spark.createDataFrame([(1, 0.12345, 1.0, 4, [1.0])], "track_id int, start_time double, end_time double, num_detections int, feature array<double>")
    assert [tuple(r) for r in sinks.track_records(tracks).collect()] == [(1, 0.123, 1.0, 4)]


def test_laplacian_variance(spark):
    rng = random.Random(1)
    pictures = [(w, h, [rng.randrange(256) for _ in range(w * h)]) for w, h in ((5, 4), (1, 1), (3, 1), (7, 6))]
    docs = spark.createDataFrame([(k, p, w) for k, (w, _, p) in enumerate(pictures)] + [(9, [], 3)], "k int, pixels array<int>, w int")
    got = {r.k: r.v for r in docs.select("k", geometry.laplacian_variance("pixels", "w").alias("v")).collect()}
    assert got[9] == 0.0
    for k, (w, h, p) in enumerate(pictures):
        grey = np.array(p, float).reshape(h, w)
        wide = np.pad(grey, [(1, 1) if h > 1 else (0, 0), (1, 1) if w > 1 else (0, 0)], "reflect")
        wide = np.pad(wide, [(0, 0) if h > 1 else (1, 1), (0, 0) if w > 1 else (1, 1)], "edge")
        out = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * grey
        assert got[k] == pytest.approx(out.var())


def test_similarity_transform(spark):
    rng = np.random.default_rng(3)
    source = rng.normal(size=(5, 2))
    a, b, shift = 1.7, -0.6, np.array([3.0, -2.0])
    target = source @ np.array([[a, b], [-b, a]]) + shift
    points = lambda m: [{"x": float(x), "y": float(y)} for x, y in m]
    kind = "array<struct<x:double,y:double>>"
    docs = spark.createDataFrame([(0, points(source), points(target)), (1, points(np.ones((3, 2))), points(np.ones((3, 2))))], f"k int, p {kind}, q {kind}")
    got = {r.k: r.t for r in docs.select("k", geometry.similarity_transform("p", "q").alias("t")).collect()}
    assert tuple(got[0]) == pytest.approx((a, b, *shift)) and got[1] is None


def test_curve_and_text(spark):
    docs = spark.createDataFrame([([1.0, 7.0, 2.0], 3, "films/a b*~é.mp4", 65.0)], "v array<double>, x int, path string, s double")
    r = docs.select(
        geometry.curve_points("v", F.col("x")).alias("points"), text.quoted_path(F.col("path")).alias("quoted"), text.relative_path(F.col("path"), "films").alias("inside"),
        text.relative_path(F.col("path"), "other/").alias("outside"), text.clock_range(F.col("s"), F.col("s") + 5).alias("range"), text.gigabytes(F.lit(3 << 29)).alias("gb"),
    ).first()
    assert [(p.x, p.y) for p in r.points] == [(0.0, pytest.approx(48.0)), (500.0, pytest.approx(0.0)), (1000.0, pytest.approx(40.0))]
    assert r.quoted == urllib.parse.quote("films/a b*~é.mp4")
    assert (r.inside, r.outside, r.range, r.gb) == ("a b*~é.mp4", "films/a b*~é.mp4", "01:05 – 01:10", "1.50")


def test_catalog_edges(spark):
    items = spark.createDataFrame([(1, 1, "failed", None), (1, 2, "failed", "late"), (2, 3, "done", "x")], "task int, id int, status string, error string")
    assert [tuple(r) for r in catalog.first_error(items, "task", "id").collect()] == [(1, "late")]
    assert catalog.finished_items(spark.createDataFrame([("done", None), ("done", ""), ("done", "d"), ("failed", "d")], "status string, out_dir string")).count() == 1
    rows = spark.createDataFrame([(k, k // 2) for k in range(9)], "id int, at int")
    assert [r.id for r in catalog.latest(rows, "at", 3).collect()] == [8, 7, 6]
    assert [tuple(r) for r in evaluation.sweep_range(rows, ["at"], ["id"]).filter("at = 1").collect()] == [(1, 2, 3)]
    segments = spark.createDataFrame([("a", [1, 2]), ("b", [1])], "video string, character_ids array<long>")
    crops = spark.createDataFrame([("a", 2), ("a", 5)], "video string, character_id long")
    assert {r.video: r.character_ids for r in catalog.characters_with_crop(segments, crops).collect()} == {"a": [2], "b": []}


def test_running_values_in_bins(spark):
    """However short the bins are, the same cuts, shots and sample numbers, by brute force."""
    from quorumscan.operators import overlap

    rng = random.Random(8)
    samples = [(v, k, rng.uniform(0, 3) + k) for v in "ab" for k in range(40) if rng.random() < 0.7]
    cuts = [(v, rng.uniform(0, 45)) for v in "ab" for _ in range(6)] + [("a", 10.0), ("c", 1.0)]
    tracks = [(v, k, rng.choice([10.0, rng.uniform(0, 45)])) for k, v in enumerate("ab" * 15)]
    s = spark.createDataFrame(samples, "video string, frame_index long, time double")
    c = spark.createDataFrame(cuts, "video string, cut double")
    t = spark.createDataFrame(tracks, "video string, track_id int, start_time double")
    before = {}
    expected = {}
    for v, k, time in samples:
        expected[v, k] = v in before and any(w == v and before[v] - 0.5 < x <= time + 0.5 for w, x in cuts)
        before[v] = time
    for length, frames in ((1.0, 1), (7.0, 5), (3600.0, 10_000)):
        got = overlap.cut_between(s, c, 0.5, length=length, frames=frames).collect()
        assert {(r.video, r.frame_index): r.is_cut for r in got} == expected
        shots = overlap.with_shot(t, c, length).collect()
        assert {r.track_id: r.shot for r in shots} == {k: sum(w == v and x <= at for w, x in cuts) for v, k, at in tracks}
    raw = spark.createDataFrame([(v, k, 10.0) for v in "ab" for k in range(60)], "video string, raw_index long, fps double")
    numbered = [sorted(map(tuple, media.sampled_frames(raw, 0.35, 5.0, n).collect())) for n in (1, 7, 1000)]
    assert numbered[0] == numbered[1] == numbered[2] and [r[1] for r in numbered[0] if r[0] == "a"] == list(range(len(numbered[0]) // 2))
