"""Linkage of any size and the tracker in stretches, against one task that sees everything."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.operators import identity, linkage, tracking

LINKS = "video string, i int, j int, diff double"


def lowest(n, links):
    """The lowest member of each node's cluster, by one matrix."""
    m = np.full((n, n), np.inf)
    for i, j, d in links:
        m[i, j] = m[j, i] = d
    first = {}
    return [first.setdefault(c, k) for k, c in enumerate(linkage.complete_linkage(m, np.inf))]


@pytest.mark.parametrize(("most", "levels"), [(3, 4), (1000, 4)])
def test_rounds_components_and_tasks_agree_also_on_ties(spark, most, levels):
    rng = random.Random(most)
    rows, want = [], {}
    for video in "ab":
        links = [(i, j, rng.randrange(levels) / levels) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.4]
        rows += [(video, *x) for x in links]
        want |= {(video, k): c for k, c in enumerate(lowest(14, links))}
    found = {(r.video, r.node): r.cluster for r in linkage.clusters(spark.createDataFrame(rows, LINKS), ["video"], most).collect()}
    assert found == {k: c for k, c in want.items() if k in found}
    assert set(found) == {(v, k) for v, *pair, _ in rows for k in pair}


def test_a_video_of_twenty_thousand_tracks(spark):
    rng = random.Random(7)
    # One component of 3,000 tracks, each near the next three, and thousands of small ones.
    links = [(i, i + s, rng.random()) for i in range(2997) for s in (1, 2, 3)]
    want = dict(enumerate(lowest(3000, links)))
    at = 3000
    while at < 20_000:
        n = min(rng.randrange(1, 6), 20_000 - at)
        group = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n)]
        want |= {at + k: at + c for k, c in enumerate(lowest(n, group))}
        links += [(at + i, at + j, d) for i, j, d in group]
        at += n
    tracks = spark.createDataFrame([("v", k) for k in range(20_000)], "video string, track_id int")
    far = [("v", k, k + 1, 2.0) for k in range(0, 19_999)]  # every track is mentioned
    differences = spark.createDataFrame([*(("v", *x) for x in links), *(x for x in far if x[1] >= 2999)], LINKS).groupBy("video", "i", "j").agg(F.min("diff").alias("diff"))
    rows = identity.assign_characters(tracks, differences, 1.0, most=1000).collect()
    numbers = {c: k for k, c in enumerate(sorted(set(want.values())))}
    assert {r.track_id: r.character_id for r in rows} == {k: numbers[c] for k, c in want.items()}


def test_no_links_at_all(spark):
    empty = spark.createDataFrame([], LINKS)
    assert linkage.clusters(empty, ["video"]).collect() == []
    tracks = spark.createDataFrame([("v", 1)], "video string, track_id int")
    assert [r.character_id for r in identity.assign_characters(tracks, empty, 0.5).collect()] == [None]
    apart = spark.createDataFrame([("v", 1, 2, 0.5)], LINKS)
    assert [r.character_id for r in identity.assign_characters(tracks, apart, 0.5).collect()] == [0]


@pytest.mark.parametrize("seed", range(2))
def test_tracker_in_stretches_equals_one_tracker(spark, seed):
    rng = random.Random(seed)
    rows = []
    for video in "ab":
        for f in range(250):
            if rng.random() < 0.8:
                boxes = {(rng.choice("pq"), rng.randrange(4) * 30 + rng.randrange(12), rng.randrange(3) * 20) for _ in range(rng.randrange(5))}
                rows += [(video, f, f * 0.3, label, x, y, x + 40, 60, 0.9) for label, x, y in boxes]
    detections = spark.createDataFrame(rows, "video string, frame_index int, time double, label string, x1 int, y1 int, x2 int, y2 int, confidence double")
    cuts = {(v, f) for v in "ab" for f in rng.sample(range(250), 10)}
    frames = spark.createDataFrame([(*c, True) for c in cuts], "video string, frame_index int, is_cut boolean")
    columns = ["video", "frame_index", "label", "x1", "y1", "track_id"]
    found = tracking.track_boxes(detections, Config(), frames, bin_frames=17).select(columns).collect()
    want = []
    every = detections.toPandas()
    for video, part in every.groupby("video"):
        mine = {f for v, f in cuts if v == video}
        marks = pd.DataFrame({"video": video, "frame_index": sorted(mine - set(part["frame_index"]))})
        part = pd.concat([part, marks], ignore_index=True)
        part["is_cut"] = part["frame_index"].isin(mine)
        out = tracking.track_rows(tracking.BoxTracker(0.3, 1), tracking.in_order(part))[columns]
        want += [(v, int(f), label, int(x), int(y), int(t)) for v, f, label, x, y, t in out.itertuples(index=False)]
    assert sorted(map(tuple, found)) == sorted(want)
