"""Steps whose work must grow no faster than their input, against plain Python and on groups that pairs would blow up."""

import datetime
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumscan.operators import catalog, identity, linkage, overlap, tracking, windows
from quorumscan.plans import queries


def test_cut_counts_equal_pairs_also_where_times_meet(spark):
    rng = random.Random(3)
    tracks = []
    for video in "ab":
        for k in range(120):
            start = rng.randrange(40) / 2
            tracks.append((video, k, rng.choice([None, *range(9)]), start, start + rng.randrange(5) / 2, 1))
    cuts = [(v, rng.randrange(60) / 2) for v in "ab" for _ in range(50)]
    found = windows.cut_scan(
        spark.createDataFrame([("a", 25.0), ("b", 22.5)], "video string, duration double"), spark.createDataFrame(cuts, "video string, cut double"),
        spark.createDataFrame(tracks, "video string, track_id int, character_id int, start_time double, end_time double, num_detections int"), 3.0, 1.0,
    )
    ends = {"a": 25.0, "b": 22.5}
    want = {(v, t, len({c for w, _, c, s, e, _ in tracks if w == v and c is not None and s < t + 3 and e >= t})) for v, t in cuts if t + 3 <= ends[v]}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_cut_counts_make_no_pairs(spark):
    n = 40_000  # 1.6 thousand million pairs
    tracks = spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("character_id"), (F.col("id") / n).alias("start_time"), (F.col("id") / n + 1.0).alias("end_time"), F.lit(1).alias("num_detections"))
    cuts = spark.range(n).select(F.lit("v").alias("video"), (F.col("id") / n).alias("cut"))
    began = time.time()
    found = windows.cut_scan(spark.createDataFrame([("v", 100.0)], "video string, duration double"), cuts, tracks, 10.0, 1.0).agg(F.min("n"), F.max("n"), F.count("n")).first()
    assert tuple(found) == (n, n, n) and time.time() - began < 60


def test_nearest_cut_makes_no_pairs(spark):
    rng = random.Random(4)
    points, cuts = [rng.randrange(400) / 4 for _ in range(90)] + [None], sorted({rng.randrange(400) / 4 for _ in range(12)})
    frame = spark.createDataFrame([("v", p) for p in points], "video string, t double")
    found = overlap.nearest_cut(frame, spark.createDataFrame([("v", c) for c in cuts + cuts], "video string, cut double"), 5.0)
    want = [(p, min((c for c in cuts if p is not None and abs(c - p) <= 5), key=lambda c: (abs(c - p), c), default=None)) for p in points]
    assert sorted(map(repr, ((r.t, r.cut) for r in found.collect()))) == sorted(map(repr, want))
    n = 40_000
    many = spark.range(n).select(F.lit("v").alias("video"), (F.col("id") / n).alias("t"))
    began = time.time()
    assert overlap.nearest_cut(many, many.select("video", F.col("t").alias("cut")), 5.0).filter("t = cut").count() == n
    assert time.time() - began < 60


def test_tracker_takes_frames_without_a_table_each():
    n = 20_000
    rows = pd.DataFrame({"frame_index": range(n), "is_cut": False, "label": "a", "x1": 0, "y1": 0, "x2": 10, "y2": 10})
    began = time.time()
    assert set(tracking.track_rows(tracking.BoxTracker(0.3, 1), rows)["track_id"]) == {0}
    assert time.time() - began < 3


@pytest.mark.parametrize("crops", [1, 3])
def test_differences_by_blocks_and_tiles_equal_pairs(spark, crops, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 3)
    rng = np.random.default_rng(crops)
    rows = [(v, t, [float(x) for x in rng.normal(size=4)]) for v in "ab" for t in range(10) for _ in range(crops)] + [("c", 1, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "video string, track_id int, feature array<double>")
    by = {}
    for v, t, x in rows:
        by.setdefault((v, t), []).append(np.array(x) / np.linalg.norm(x))
    want = {(v, t, u): np.median([1 - x @ y for x in a for y in b]) for (v, t), a in by.items() for (w, u), b in by.items() if v == w and t < u}
    found = {(r.video, r.i, r.j): r["diff"] for r in identity.crop_differences(frame, ["video"]).collect()}
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)
    near = identity.crop_differences(frame, ["video"], below=0.8).collect()
    assert {(r.video, r.i, r.j) for r in near} == {k for k, d in want.items() if d < 0.8}
    assert identity.cropped(frame, ["video"]).count() == 20


def test_characters_with_crop_carry_no_set_of_a_whole_video(spark):
    rows = [("a", 0, [3, 1, 2, 3]), ("a", 1, []), ("b", 0, [1]), ("a", 2, None), ("a", 3, [3, 1, 2, 3])]
    segments = spark.createDataFrame(rows, "video string, k int, character_ids array<int>")
    crops = spark.createDataFrame([("a", 3), ("a", 2), ("a", 2)], "video string, character_id int")
    found = catalog.characters_with_crop(segments, crops)
    assert {(r.video, r.k): r.character_ids for r in found.collect()} == {("a", 0): [3, 2], ("a", 1): [], ("b", 0): [], ("a", 2): None, ("a", 3): [3, 2]}
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_cosine_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 2)
    vectors = [(k, [float(k % 3), float(k % 2)]) for k in range(9)]
    frame = spark.createDataFrame([("v", k, x) for k, x in vectors], "video string, id int, feature array<double>")
    found = {(r.i, r.j): r["diff"] for r in identity.cosine_pairs(frame, ["video"], "id").collect()}
    assert len(found) == 36
    for (i, j), d in found.items():
        x, y = np.array(vectors[i][1]), np.array(vectors[j][1])
        size = np.linalg.norm(x) * np.linalg.norm(y)
        assert d == pytest.approx(1 - (x @ y / size if size else 0))


@pytest.mark.parametrize(("most", "most_pairs", "side"), [(256, 1 << 24, 256), (3, 1 << 24, 7), (2, 30, 4), (0, 5, 2)])
def test_clusters_of_vectors_equal_one_matrix_also_on_ties(monkeypatch, most, most_pairs, side):
    monkeypatch.setattr(linkage, "SIDE", side)
    rng = np.random.default_rng(side)
    for n in (0, 1, 2, 9, 40, 60):
        for d, coarse in ((2, True), (3, True), (12, False)):
            rows = np.column_stack([np.full(n, d), rng.integers(-2, 3, (n, d)) if coarse else rng.normal(size=(n, d))]).astype(float)
            rows[1::7] = np.nan
            x = identity._unit(rows)
            whole = identity._apart(x, x)
            near = identity._near(x, x, 0.6)
            assert (near == np.where(whole < 0.6, whole, np.inf)).all()
            want = linkage.complete_linkage(near, 0.6)
            assert linkage.clusters_of_vectors(x, lambda a, b: identity._near(a, b, 0.6), most, most_pairs).tolist() == want


@pytest.mark.parametrize("crops", [1, 2])
def test_window_counts_of_crops_equal_those_of_differences(spark, monkeypatch, crops):
    monkeypatch.setattr(identity, "ROW", 3)
    rng = np.random.default_rng(crops)
    rows = [(v, t, [float(x) for x in rng.normal(size=3)]) for v in "ab" for t in range(20) for _ in range(crops)] + [("c", 1, [1.0, 0.0]), ("a", 90, None)]
    members = [(v, k, t) for v in "abc" for k in range(-3, 8) for t in range(24) if (t * 7 + k) % 3] + [("d", 2, 1), ("a", 1, 90)]
    frame = spark.createDataFrame(rows, "video string, track_id int, feature array<double>")
    inside = spark.createDataFrame(members + members, "video string, k long, track_id int")
    want = identity.window_scope_counts(inside, identity.crop_differences(frame, ["video"]), 0.7, known=frame.select("video", "track_id").distinct())
    found = identity.window_scope_counts_of_crops(inside, frame, 0.7)
    assert found.schema == want.schema and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_window_scope_query_writes_no_pairs_and_equals_sql_on_odd_tables(spark, tmp_path, monkeypatch):
    begin = datetime.datetime(2024, 1, 1)
    users = [*range(0, 2400, 4), 1, 5, 9, 2, 4001, 4003]  # 600 of a video in each of two hours, a few of others, and two without a vector
    events = [(k, begin + datetime.timedelta(hours=h, minutes=k % 50), u, "view", 1.0, "{}") for h in (0, 30) for k, u in enumerate(users)]
    events += [(9_999, begin + datetime.timedelta(hours=50), 4003, "view", 1.0, "{}")]
    vectors = [(u, [1.0, u % 16 / 100.0] if u % 3 else [u % 7 - 3.0, 1.0], 0) for u in range(2400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows, plain = [], linkage.settled
    monkeypatch.setattr(linkage, "settled", lambda df, label: rows.append(plain(df, label)) or rows[-1])
    found = queries.QUERIES["q21_window_scope_count"](spark, str(tmp_path)).collect()
    assert sum(df.count() for df in rows) < 3000  # pairs of 600 tracks went to a table before
    counts = {(r.video, r.k): r.n for r in found}
    assert counts["2", 0] == counts["2", 30] == 1 and counts["3", 50] == 0
    # SQL takes its time over 600 tracks: it is asked for the videos of few.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE user_id % 4 > 0 OR user_id < 120")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(v, k): n for v, k, n in con.execute(queries.ORACLES["q21_window_scope_count"]).fetchall()}
    assert {x: counts[x] for x in want if x[0] != "0"} == {x: n for x, n in want.items() if x[0] != "0"}
    few = tmp_path / "few"
    spark.read.parquet(f"{tmp_path}/events.parquet").filter("user_id % 4 > 0 OR user_id < 120").write.parquet(f"{few}/events.parquet")
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").write.parquet(f"{few}/embeddings.parquet")
    assert {(r.video, r.k): r.n for r in queries.QUERIES["q21_window_scope_count"](spark, str(few)).collect()} == want
