"""Further queries over a data folder: stored scans, library bookkeeping, evaluation details."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumscan import sinks
from quorumscan.functions import geometry, metrics, text
from quorumscan.operators import catalog, evaluation, identity, selection, windows
from quorumscan.plans import domain
from quorumscan.plans.domain import LENGTH, SHIFT, STEP, THRESHOLD_SQL, WALK_SQL, micros, table
from quorumscan.plans.queries import SNAP_CANDIDATES, STATUS, on_events, query, scan
from quorumscan.shared import settled
from quorumscan.sources import media

#: The threshold of the replays.
X = 5
SNAP_AT_X = SNAP_CANDIDATES.replace(THRESHOLD_SQL, f"x AS (SELECT {X} AS x)")
STRICT_WALK_SQL = """
    rich AS (
        SELECT c.*, s.n AS raw_count, CAST(ceil((c.raw_start + 21600) / 3600 - 1e-9) AS BIGINT) AS raw_next FROM cand c JOIN scan s USING (video, k)
    ), succ AS (
        SELECT a.video, a.k, (SELECT min(d.k) FROM cand d WHERE d.video = a.video AND d.k >= a.next_k) AS after,
               (SELECT min(d.k) FROM cand d WHERE d.video = a.video AND d.k >= a.raw_next) AS raw_after FROM rich a
    ), walk AS (
        SELECT r.video, r.k, false AS refused, r.start + 21600 AS until FROM rich r JOIN (SELECT video, min(k) AS k FROM cand GROUP BY video) USING (video, k)
        UNION ALL
        SELECT w.video, r.k, w.until > r.start, CASE WHEN w.until > r.start THEN r.raw_start ELSE r.start END + 21600
        FROM walk w JOIN succ s USING (video, k) JOIN rich r ON r.video = w.video AND r.k = CASE WHEN w.refused THEN s.raw_after ELSE s.after END
    )
"""


def stored(spark, sf_dir):
    """The scans of all videos as they are stored, read back.  Tracks and videos are written once, for both scans read them."""
    tracks, videos, cuts = settled(domain.tracks(spark, sf_dir), "tracks"), settled(domain.videos(spark, sf_dir), "videos"), domain.cuts(spark, sf_dir)
    at_windows, at_cuts = windows.window_scan(videos, tracks, LENGTH, STEP), windows.cut_scan(videos, cuts, tracks, LENGTH, STEP)
    return media.parse_scans(sinks.stored_scans(videos, at_windows, cuts, at_cuts, LENGTH, STEP))


@query(on_events(f"""{SNAP_AT_X} SELECT c.video, c.k, CAST(round(c.start * 1000000) AS BIGINT) AS start_us, c.character_count,
    CAST(round((c.start - c.raw_start) * 1000000) AS BIGINT) AS shift_us FROM walk w JOIN cand c USING (video, k)""", True))
def q47_stored_replay(spark, sf_dir):
    found = selection.replay_stored(stored(spark, sf_dir), X, LENGTH, STEP, SHIFT)
    return found.select("video", "k", micros("start").alias("start_us"), "character_count", micros("snap_shift").alias("shift_us"))


@query(on_events(f"""{SNAP_AT_X.replace(WALK_SQL, STRICT_WALK_SQL)} SELECT r.video, r.k,
    CAST(round(CASE WHEN refused THEN r.raw_start ELSE r.start END * 1000000) AS BIGINT) AS start_us,
    CASE WHEN refused THEN raw_count ELSE character_count END AS character_count FROM walk w JOIN rich r USING (video, k)""", True))
def q48_strict_segments(spark, sf_dir):
    found = selection.replay_stored(stored(spark, sf_dir), X, LENGTH, STEP, SHIFT, strict_non_overlap=True)
    return found.select("video", "k", micros("start").alias("start_us"), "character_count")


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS position FROM events")
def q49_queue_positions(spark, sf_dir):
    return catalog.queue_positions(table(spark, sf_dir, "events"), ["event_type"], "event_id").select("event_type", "event_id", F.col("position").cast("long").alias("position"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS segments, CAST(floor(sum(p_size) * 3000.0::DOUBLE / nullif(sum(p_partkey % 6000), 0) + 0.5) AS BIGINT) AS percent FROM part")
def q50_hit_share(spark, sf_dir):
    return catalog.hit_share(table(spark, sf_dir, "part").select(F.col("p_size").alias("segments"), (F.col("p_partkey") % 6000).cast("double").alias("duration")), 30.0)


@query(f"SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS error FROM (SELECT *, {STATUS} AS status FROM orders) WHERE status = 'failed' GROUP BY o_custkey")
def q51_first_error(spark, sf_dir):
    items = table(spark, sf_dir, "orders").withColumn("status", F.expr(STATUS)).withColumn("error", F.col("o_orderpriority"))
    return catalog.first_error(items, "o_custkey", "o_orderkey")


@query("""
    SELECT count(*) FILTER (style = truth_style) AS hits, count(*) AS n, CAST(round(count(*) FILTER (style = truth_style) / CAST(count(*) AS DOUBLE) * 1000000) AS BIGINT) AS micro
    FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'real' ELSE '2d' END AS style, CASE WHEN doc_id % 5 = 0 THEN 'real' ELSE '2d' END AS truth_style FROM documents) WHERE style IS NOT NULL
""")
def q52_routing_accuracy(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(n % 4 == 0, None).when(n % 3 == 0, "real").otherwise("2d").alias("style"), F.when(n % 5 == 0, "real").otherwise("2d").alias("truth_style"))
    return evaluation.routing_accuracy(rows).select("hits", "n", F.round(F.col("accuracy") * 1000000).cast("long").alias("micro"))


@query("""
    WITH r AS (SELECT o_custkey, count(*) AS segments, CAST(floor(sum(o_orderkey % 600) / 30.0::DOUBLE) AS BIGINT) AS max_windows FROM orders GROUP BY o_custkey)
    SELECT CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(max_windows) AS BIGINT) AS max_windows, CAST(round(100.0::DOUBLE * sum(segments) / greatest(sum(max_windows), 1) * 1000) AS BIGINT) AS milli_percent FROM r
""")
def q53_grand_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.lit(1)).alias("counts"), F.sum(F.col("o_orderkey") % 600).alias("duration"))
    total = evaluation.grand_total(evaluation.run_summary(rows.withColumn("window_seconds", F.lit(30.0))))
    return total.select("segments", "max_windows", F.round(F.col("percent") * 1000).cast("long").alias("milli_percent"))


@query("""
    SELECT event_type, CAST(user_id % 5 AS BIGINT) AS row, count(*) FILTER (event_id % 3 = 0) AS "0", count(*) FILTER (event_id % 3 = 1) AS "1", count(*) FILTER (event_id % 3 = 2) AS "2" FROM events GROUP BY ALL
""")
def q54_sweep_table(spark, sf_dir):
    cells = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("row"), (F.col("event_id") % 3).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.sweep_table(cells, ["event_type"], "row", "column", [0, 1, 2], "n").na.fill(0)


@query(on_events("SELECT video, min(n) AS min_n, max(n) AS max_n FROM scan GROUP BY video"))
def q55_sweep_range(spark, sf_dir):
    return evaluation.sweep_range(scan(spark, sf_dir), ["video"], ["n"])


@query("""
    WITH f AS (SELECT event_type, event_id, user_id % 7 AS raw, min(event_id) OVER (PARTITION BY event_type, user_id % 7) AS first FROM events)
    SELECT event_type, event_id, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY first) - 1 AS BIGINT) AS label FROM f
""")
def q56_dense_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("user_id") % 7).alias("raw"))
    return identity.dense_labels(rows, "event_type", "raw", "event_id").select("event_type", "event_id", F.col("label").cast("long").alias("label"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(round(CASE WHEN doc_id % 5 + n_chars % 2 = 0 THEN 1.0::DOUBLE
        ELSE (least(n_chars % 3, doc_id % 5) + least(doc_id % 4, n_chars % 2)) / CAST(doc_id % 5 + n_chars % 2 AS DOUBLE) END * 1000000) AS BIGINT) END AS micro FROM documents
""")
def q57_shotwise_recall(spark, sf_dir):
    n, c = F.col("doc_id"), F.col("n_chars")
    found = F.when(n % 6 == 0, F.array(c % 3)).otherwise(F.array(c % 3, n % 4))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("predicted"), F.array(n % 5, c % 2).alias("truth"))
    return rows.select("doc_id", F.round(metrics.shotwise_recall("predicted", "truth") * 1000000).cast("long").alias("micro"))


@query("SELECT p_partkey, p_size - 1 AS x1, p_size % 7 - 2 AS y1, p_size + 3 AS x2, p_size % 7 + 4 AS y2 FROM part")
def q58_distances_to_box(spark, sf_dir):
    size = F.col("p_size")
    b = geometry.distances_to_box(size, size % 7, tuple(map(F.lit, (1, 2, 3, 4))))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))))


@query("SELECT doc_id, array_to_string([CAST(floor(n_chars * (i + 0.5::DOUBLE) / 5) AS INTEGER) FOR i IN range(0, 5)], ',') AS frames FROM documents")
def q59_probe_frames(spark, sf_dir):
    frames = media.probe_frames(F.col("n_chars"), 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(frames.cast("array<string>"), ",").alias("frames"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def q60_latest_tasks(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "orders"), "o_orderdate", 50, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
    SELECT o_custkey AS task_id, o_orderkey, coalesce(p_name, '?') AS name, coalesce(CAST(p_size AS DOUBLE), 0) AS duration
    FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = o_orderkey % 500 WHERE c_custkey % 3 = 0
""")
def q61_items_with_assets(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")).filter("task_id % 3 = 0")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", (F.col("o_orderkey") % 500).alias("asset_id"))
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("duration"))
    return catalog.items_with_assets(tasks, items, assets).select("task_id", "o_orderkey", "name", "duration")


@query("""
    WITH s AS (SELECT event_type AS video, event_id // 50 AS k, list_sort(list(DISTINCT user_id)) AS ids FROM events GROUP BY ALL),
    c AS (SELECT event_type AS video, list(DISTINCT user_id) AS shown FROM events WHERE value > 200 GROUP BY ALL)
    SELECT video, k, array_to_string(list_filter(ids, lambda x: list_contains(coalesce(shown, []), x)), ',') AS ids FROM s LEFT JOIN c USING (video)
""")
def q62_characters_with_crop(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("video", F.col("event_type"))
    segments = e.groupBy("video", F.floor(F.col("event_id") / 50).alias("k")).agg(F.sort_array(F.collect_set("user_id")).alias("character_ids"))
    crops = e.filter("value > 200").select("video", F.col("user_id").alias("character_id"))
    return catalog.characters_with_crop(segments, crops).select("video", "k", F.array_join(F.col("character_ids").cast("array<string>"), ",").alias("ids"))


@query(f"SELECT o_orderkey FROM (SELECT *, {STATUS} AS status FROM orders) WHERE status = 'done' AND o_orderkey % 4 <> 0")
def q63_finished_items(spark, sf_dir):
    items = table(spark, sf_dir, "orders").withColumn("status", F.expr(STATUS)).withColumn("out_dir", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("runs"))
    return catalog.finished_items(items).select("o_orderkey")


@query("SELECT page_id, replace(url_encode(url), '%2F', '/') AS path FROM pages")
def q64_quoted_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.quoted_path(F.col("url")).alias("path"))


@query("""
    WITH r AS (SELECT doc_id // 4 AS title, doc_id FROM documents)
    SELECT a.doc_id AS clip, b.doc_id AS film FROM r a JOIN r b USING (title) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1
""")
def q65_pairs_by_title(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("title"), "doc_id")
    clips, films = rows.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "clip"), rows.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "film")
    return media.pairs_by_title(clips, films).select("clip", "film")
