"""Streams against the batch operators: boards, ends of videos, exact sliding counts, progress."""

import random

import pytest
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.operators import tracking
from quorumscan.streaming import progress, tracker
from quorumscan.streaming.boards import offered, stream_track_boards

DETECTIONS = "video string, frame_index int, time double, label string, x1 int, y1 int, x2 int, y2 int, confidence double, blur_var double, frontal double, is_cut boolean, ts timestamp"
CONFIG = Config(crops_per_track=2, crop_min_gap_frames=3, frontal_weight=0.5)


@pytest.fixture
def streaming(spark):
    """The settings that timers and their state need, for one test."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "true",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of_video(video, seed, begin=1000):  # at the epoch itself, where the watermark begins, rows are late
    rng = random.Random(seed)
    rows = []
    for f in range(40):
        for k in range(2):
            if rng.random() < 0.8:
                x = 60 * k + f * (k - 1) + rng.randrange(4)
                rows.append((video, f, f * 0.3, "a", x, 0, x + 50, 50, 0.5 + rng.randrange(50) / 100, float(rng.randrange(20, 200)), rng.choice([None, 0.2, 0.9]), f in (11, 25), begin + f))
    return rows


def written(spark, rows, path, parts):
    """One file for each part (lowest and highest second), in order."""
    df = spark.createDataFrame(rows, DETECTIONS.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k, (lo, hi) in enumerate(parts):
        df.filter((F.unix_timestamp("ts") >= lo) & (F.unix_timestamp("ts") < hi)).coalesce(1).write.parquet(f"{path}/part={k:03d}")
    return df


def test_boards_of_a_stream_equal_the_batch_and_state_goes(streaming, tmp_path):
    spark = streaming
    rows = rows_of_video("v", 1) + rows_of_video("w", 2) + [("late", 0, 0.0, "a", 0, 0, 9, 9, 0.9, 90.0, None, False, t) for t in (1500, 1900)]
    every = written(spark, rows, f"{tmp_path}/in", [(1000, 1013), (1013, 1030), (1030, 1040), (1500, 1501), (1900, 1901)])
    source = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_track_boards(source, CONFIG, idle=60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    found = {(r.video, r.track_id): r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.video != "late"}

    tracked = tracking.track_boxes(every.filter("video != 'late'"), CONFIG)
    tracks = {(r.video, r.track_id): r for r in tracking.tracks_of(tracked).collect()}
    from quorumscan.functions.frontal import representative_score

    score = representative_score(F.col("blur_var"), F.col("confidence"), F.col("frontal"), 0.5)
    boards = {}
    for r in tracking.spaced_representatives(tracked, ["video", "track_id"], score, "frame_index", 2, 3).orderBy("rank").collect():
        boards.setdefault((r.video, r.track_id), []).append((r.frame_index, pytest.approx(r.score)))
    assert set(found) == set(tracks)
    for k, r in found.items():
        t = tracks[k]
        assert (r.label, r.start_time, r.end_time, r.num_detections) == (t.label, t.start_time, t.end_time, t.num_detections)
        assert [(b.frame_index, b.score) for b in r.board] == boards[k]
    # Both videos have ended by the watermark: of the last two only the one that still waits is in the state.
    state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(state) > state[-1]


def test_a_board_is_bounded_and_spaced():
    board = []
    for frame, score in enumerate([5.0, 9.0, 1.0, 7.0, 9.0]):
        board = offered(board, score, frame, 2, 2)
    assert board == [(9.0, 1), (9.0, 4)]
    assert offered([], 1.0, 3, 1, 0) == [(1.0, 3)]


def test_sliding_counts_of_a_stream_are_exact(streaming, tmp_path):
    spark = streaming
    rng = random.Random(3)
    rows = sorted((rng.randrange(1, 600), f"c{rng.randrange(40)}" if rng.random() < 0.9 else "") for _ in range(900))
    events = spark.createDataFrame([(s, c or None) for s, c in rows], "s long, character string").withColumn("ts", F.timestamp_seconds("s"))
    end = spark.createDataFrame([(100_000, "z")], "s long, character string").withColumn("ts", F.timestamp_seconds("s"))
    for k in range(4):
        events.filter(f"s >= {150 * k} AND s < {150 * (k + 1)}").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    end.coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counted = tracker.sliding_characters(source, "ts", "character", "60 seconds", "20 seconds", "0 seconds")
    q = counted.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    want = events.filter("character IS NOT NULL").groupBy(F.window("ts", "60 seconds", "20 seconds")).agg(F.countDistinct("character").alias("n"))
    expected = {(r.w, r.n) for r in want.select(F.unix_timestamp("window.start").alias("w"), "n").collect()}
    found = [(r.w, r.n) for r in spark.read.parquet(f"{tmp_path}/out").select(F.unix_timestamp("start").alias("w"), "n").collect() if r.w < 90_000]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_progress_stops_at_terminal_states(spark, tmp_path):
    steps = [("t", "a", 0, "running", "cuts", 0.5), ("t", "b", 0, "queued", None, 0.0), ("t", "a", 1, "running", "scan", 0.5), ("t", "a", 2, "done", "clips", 1.0), ("t", "b", 1, "failed", "scan", 0.2)]
    schema = "task_id string, item_id string, seq int, status string, stage string, fraction double"
    for k, row in enumerate(steps):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = []
    q = progress.progress_stream(source, lambda df, n: seen.extend(map(tuple, df.collect())), f"{tmp_path}/cp", expected=2, interval="100 milliseconds")
    assert q.awaitTermination(120)
    assert {s[3] is not None and s[2] for s in seen} >= {"running", "done", "failed"}
    assert [s[1] for s in seen if s[2] in progress.TERMINAL] == ["a", "b"]
