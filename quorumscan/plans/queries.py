"""Queries over a data folder, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.functions import geometry, text
from quorumscan.operators import catalog, evaluation, gates, identity, overlap, selection, tracking, windows
from quorumscan.plans import domain
from quorumscan.plans.domain import GAP, LENGTH, SHIFT, SQL, STEP, THRESHOLD_SQL, WALK_SQL, micros, table
from quorumscan.shared import settled
from quorumscan.sources import media

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def on_events(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL} {rest}"


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_scan(domain.videos(spark, sf_dir), domain.tracks(spark, sf_dir), LENGTH, STEP)


def threshold(scanned: DataFrame) -> int:
    """The upper quartile of the counts: one number."""
    return scanned.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY n)").alias("x")).first().x


def chosen(spark: SparkSession, sf_dir: str, snap: bool) -> DataFrame:
    """Segments at the upper quartile.  Tracks and the scan are written once: the threshold is read from the scan, and the walk is a replay of it."""
    tracks, videos = settled(domain.tracks(spark, sf_dir), "tracks"), settled(domain.videos(spark, sf_dir), "videos")
    scanned = settled(windows.window_scan(videos, tracks, LENGTH, STEP), "scan")
    more = {}
    if snap:
        cuts = domain.cuts(spark, sf_dir)
        more = {"videos": videos, "cuts": cuts, "at_cuts": windows.cut_scan(videos, cuts, tracks, LENGTH, STEP), "max_shift": SHIFT}
    return selection.replay(scanned, threshold(scanned), LENGTH, STEP, **more)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: the value is confidence and sharpness, the event number the box."""
    e = domain.events(spark, sf_dir)
    return e.select(
        "event_id", "video", F.col("event_id").cast("int").alias("frame_index"), F.col("t").alias("time"), F.col("event_type").alias("label"),
        (F.col("event_id") % 37).cast("int").alias("x1"), (F.col("event_id") % 11).cast("int").alias("y1"),
        (F.col("event_id") % 37 + 20).cast("int").alias("x2"), (F.col("event_id") % 11 + F.col("event_id") % 90).cast("int").alias("y2"),
        (F.col("value") / 500).alias("confidence"), F.when(F.col("event_type") != "view", F.col("value")).alias("blur_var"),
        F.lit(2).alias("num_eyes"), F.lit(1.0).alias("frontal"), F.lit(1000).alias("frame_height"),
    )


@query("""
    SELECT event_id, value / 500 >= 0.1 AND event_id % 90 >= 45 AND coalesce(CASE WHEN event_type <> 'view' THEN value END, 0) >= 50 AS kept FROM events
""")
def q01_quality_gate(spark, sf_dir):
    return gates.detection_records(detections(spark, sf_dir), Config(conf_threshold=0.1)).select("event_id", "kept")


@query("""
    WITH f AS (SELECT user_id % 4 AS v, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS i FROM events),
    s AS (SELECT v, i, floor((i / 10.0::DOUBLE + 1e-9::DOUBLE) / 0.35::DOUBLE) AS due, floor(((i - 1) / 10.0::DOUBLE + 1e-9::DOUBLE) / 0.35::DOUBLE) AS before FROM f)
    SELECT CAST(v AS VARCHAR) AS video, row_number() OVER (PARTITION BY v ORDER BY i) - 1 AS sample_index, i AS raw_index
    FROM s WHERE (i = 0 OR due > before) AND i / 10.0::DOUBLE < 100
""")
def q02_sampled_scan(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("video").orderBy("event_id")) - 1
    frames = domain.events(spark, sf_dir).select("video", at.cast("long").alias("raw_index"), F.lit(10.0).alias("fps"))
    return media.sampled_frames(frames, 0.35, 100.0).select("video", F.col("sample_index").cast("long").alias("sample_index"), "raw_index")


@query(on_events("SELECT character_id AS user_id, track_no, CAST(round(start_time * 1000000) AS BIGINT) AS start_us, CAST(round(end_time * 1000000) AS BIGINT) AS end_us, num_detections FROM tracks"))
def q03_sessionise_tracks(spark, sf_dir):
    return domain.tracks(spark, sf_dir).select(F.col("character_id").alias("user_id"), "track_no", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "num_detections")


@query(on_events("SELECT track_id, num_detections FROM tracks WHERE end_time - start_time >= 7200"))
def q04_short_track_filter(spark, sf_dir):
    return gates.drop_short_tracks(domain.tracks(spark, sf_dir), 7200.0).select("track_id", "num_detections")


@query(on_events("SELECT user_id, track_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, track_no ORDER BY value DESC, event_id) AS r FROM sess) WHERE r = 1"))
def q05_representative_argmax(spark, sf_dir):
    return tracking.representatives(domain.sessions(spark, sf_dir), ["user_id", "track_no"], F.col("value"), "event_id").select("user_id", "track_no", "event_id")


@query("SELECT user_id, event_id, CAST(r - 1 AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def q06_topk_board(spark, sf_dir):
    return tracking.representatives(table(spark, sf_dir, "events"), ["user_id"], F.col("value"), "event_id", 3).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query(on_events(""", clicks AS (
        SELECT *, lag(t) OVER (PARTITION BY video ORDER BY event_id) AS prev FROM ev WHERE event_type = 'click'
    )
    SELECT event_id, EXISTS (SELECT 1 FROM cuts WHERE cuts.video = clicks.video AND cut > prev - 60 AND cut <= clicks.t + 60) AS is_cut FROM clicks"""))
def q07_cut_between(spark, sf_dir):
    clicks = domain.events(spark, sf_dir).filter("event_type = 'click'").select("video", "event_id", F.col("t").alias("time"))
    return overlap.cut_between(clicks, domain.cuts(spark, sf_dir), 60.0, "event_id").select("event_id", "is_cut")


@query(on_events("""SELECT event_id, (
        SELECT CAST(round(cut * 1000000) AS BIGINT) FROM cuts WHERE cuts.video = ev.video AND abs(cut - ev.t) <= 1800 ORDER BY abs(cut - ev.t), cut LIMIT 1
    ) AS cut_us FROM ev WHERE event_type = 'click'"""))
def q08_nearest_cut(spark, sf_dir):
    clicks = domain.events(spark, sf_dir).filter("event_type = 'click'").select("video", "event_id", "t")
    return overlap.nearest_cut(clicks, domain.cuts(spark, sf_dir), SHIFT).select("event_id", micros("cut").alias("cut_us"))


@query(on_events(""", placed AS (
        SELECT r.video, (SELECT count(*) FROM cuts c WHERE c.video = r.video AND c.cut <= r.start_time) AS shot, r.character_id FROM tracks r
    ), shots AS (
        SELECT v.video, unnest(range(0, coalesce(n, 0) + 1)) AS shot
        FROM videos v LEFT JOIN (SELECT video, count(*) AS n FROM cuts GROUP BY video) USING (video)
    )
    SELECT video, shot, count(DISTINCT character_id) AS n FROM shots LEFT JOIN placed USING (video, shot) GROUP BY ALL"""))
def q09_characters_per_shot(spark, sf_dir):
    return overlap.characters_per_shot(domain.tracks(spark, sf_dir), domain.cuts(spark, sf_dir))


@query(on_events("SELECT w.video, w.k, r.track_id FROM windows w JOIN tracks r ON r.video = w.video AND r.start_time < w.t + 21600 AND r.end_time >= w.t"))
def q10_overlap_join(spark, sf_dir):
    grid = windows.window_grid(domain.videos(spark, sf_dir), LENGTH, STEP)
    return overlap.overlap_join(grid, domain.tracks(spark, sf_dir), LENGTH).select("video", "k", "track_id")


@query(on_events("SELECT video, k, n FROM scan"))
def q11_window_scan(spark, sf_dir):
    return scan(spark, sf_dir).select("video", "k", "n")


@query(on_events(""", shown AS (
        SELECT w.video, w.k, r.character_id, sum(num_detections * 3600) AS s
        FROM windows w JOIN tracks r ON r.video = w.video AND r.start_time < w.t + 21600 AND r.end_time >= w.t GROUP BY ALL
    )
    SELECT w.video, w.k, count(s.character_id) AS n FROM windows w LEFT JOIN shown s ON s.video = w.video AND s.k = w.k AND s.s >= 7200 GROUP BY ALL"""))
def q12_screen_time_gate(spark, sf_dir):
    return windows.window_scan(domain.videos(spark, sf_dir), domain.tracks(spark, sf_dir), LENGTH, STEP, 7200.0).select("video", "k", "n")


@query(on_events("SELECT video, CAST(x AS BIGINT) AS x, count(*) FILTER (n >= x) AS hits, count(*) AS total FROM scan, (SELECT unnest(range(2, 11)) AS x) GROUP BY ALL"))
def q13_sensitivity(spark, sf_dir):
    return windows.sensitivity(scan(spark, sf_dir), list(range(2, 11)), ["video"]).select("video", F.col("x").cast("long").alias("x"), "hits", "total")


@query(on_events(""", sized AS (SELECT *, count(*) OVER (PARTITION BY video) AS m FROM scan), b AS (
        SELECT DISTINCT video, m, greatest(1.0::DOUBLE, m / 50.0::DOUBLE) AS s, unnest(range(0, least(m, 50))) AS bucket FROM sized
    )
    SELECT b.video, b.bucket, max(n) AS n FROM b JOIN scan c ON c.video = b.video
        AND c.k >= floor(b.bucket * s) AND c.k < greatest(floor((b.bucket + 1) * s), floor(b.bucket * s) + 1) GROUP BY ALL"""))
def q14_curve(spark, sf_dir):
    return windows.curve(scan(spark, sf_dir), 50)


GRID_CANDIDATES = f""", {THRESHOLD_SQL}, cand AS (
    SELECT video, k, t AS start, n AS character_count, t AS raw_start, CAST(ceil((t + 21600) / 3600 - 1e-9) AS BIGINT) AS next_k FROM scan, x WHERE n >= x
), {WALK_SQL}"""
SNAP_CANDIDATES = f""", {THRESHOLD_SQL}, cut_scan AS (
    SELECT DISTINCT c.video, c.cut, (
        SELECT count(DISTINCT character_id) FROM tracks r WHERE r.video = c.video AND r.start_time < c.cut + 21600 AND r.end_time >= c.cut
    ) AS n FROM cuts c JOIN videos v ON v.video = c.video WHERE c.cut + 21600 <= v.duration + 1e-6
), near AS (
    SELECT s.video, s.k, s.t, s.n, arg_min(c.cut, (abs(c.cut - s.t), c.cut)) AS cut
    FROM scan s CROSS JOIN x LEFT JOIN cuts c ON c.video = s.video AND abs(c.cut - s.t) <= 1800 WHERE s.n >= x.x GROUP BY ALL
), cand AS (
    SELECT a.video, a.k, CASE WHEN q.n >= x.x THEN a.cut ELSE a.t END AS start, CASE WHEN q.n >= x.x THEN q.n ELSE a.n END AS character_count, a.t AS raw_start,
           CAST(ceil((CASE WHEN q.n >= x.x THEN a.cut ELSE a.t END + 21600) / 3600 - 1e-9) AS BIGINT) AS next_k
    FROM near a CROSS JOIN x LEFT JOIN cut_scan q ON q.video = a.video AND q.cut = a.cut
), {WALK_SQL}"""
SEGMENT_COLUMNS = "c.video, c.k, CAST(round(c.start * 1000000) AS BIGINT) AS start_us, c.character_count, CAST(round(c.raw_start * 1000000) AS BIGINT) AS raw_start_us"


@query(on_events(f"{GRID_CANDIDATES} SELECT {SEGMENT_COLUMNS} FROM walk w JOIN cand c USING (video, k)", True))
def q15_greedy_segments(spark, sf_dir):
    return chosen(spark, sf_dir, False).select("video", "k", micros("start").alias("start_us"), "character_count", micros("raw_start").alias("raw_start_us"))


@query(on_events(f"{SNAP_CANDIDATES} SELECT {SEGMENT_COLUMNS} FROM walk w JOIN cand c USING (video, k)", True))
def q16_greedy_with_snap(spark, sf_dir):
    return chosen(spark, sf_dir, True).select("video", "k", micros("start").alias("start_us"), "character_count", micros("raw_start").alias("raw_start_us"))


@query(on_events(f"""{GRID_CANDIDATES}
    SELECT w.video, w.k, array_to_string(list_sort(list(DISTINCT r.character_id)), ',') AS character_ids, count(DISTINCT r.track_id) AS n_tracks
    FROM walk w JOIN cand c USING (video, k) JOIN tracks r ON r.video = w.video AND r.start_time < c.start + 21600 AND r.end_time >= c.start GROUP BY ALL""", True))
def q17_segment_members(spark, sf_dir):
    found = selection.with_members(chosen(spark, sf_dir, False), domain.tracks(spark, sf_dir), LENGTH)
    return found.select("video", "k", F.array_join(F.transform("character_ids", lambda x: x.cast("string")), ",").alias("character_ids"), F.size("track_ids").cast("long").alias("n_tracks"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as crops: a label's vectors are ten tracks."""
    return table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 10).alias("track_id"), "vec_id", F.col("embedding").alias("feature"))


@query("""
    SELECT a.vec_id AS i, b.vec_id AS j, CAST(floor((1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) * 1000) AS BIGINT) AS milli
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = b.vec_id % 10 AND a.vec_id < b.vec_id
""")
def q18_cosine_pairs(spark, sf_dir):
    pairs = identity.cosine_pairs(crops(spark, sf_dir), ["label", "track_id"], "vec_id")
    return pairs.select("i", "j", F.floor(F.col("diff") * 1000).cast("long").alias("milli"))


@query("""
    SELECT a.label, a.vec_id % 10 AS i, b.vec_id % 10 AS j,
           CAST(floor(median(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) * 1000) AS BIGINT) AS milli
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 < b.vec_id % 10 GROUP BY ALL
""")
def q19_median_difference(spark, sf_dir):
    return identity.crop_differences(crops(spark, sf_dir), ["label"]).select("label", "i", "j", F.floor(F.col("diff") * 1000).cast("long").alias("milli"))


#: Complete linkage under 0.9 over the pairs d (g, i, j, diff) of the members v (g, id): clusters bear their least member's number.
LINKAGE_SQL = """
    w AS (
        SELECT g, 0 AS step, list(struct_pack(id := id, c := id)) AS members, true AS merged FROM v GROUP BY g
        UNION ALL
        SELECT w.g, w.step + 1, CASE WHEN best IS NULL THEN w.members ELSE list_transform(w.members, lambda m: struct_pack(id := m.id, c := CASE WHEN m.c = best.b THEN best.a ELSE m.c END)) END, best IS NOT NULL
        FROM w LEFT JOIN (
            SELECT g, arg_min(struct_pack(a := a, b := b), struct_pack(d := dist, a := a, b := b)) AS best FROM (
                SELECT d.g, least(p.c, q.c) AS a, greatest(p.c, q.c) AS b, max(diff) AS dist
                FROM d JOIN (SELECT g, unnest(members, recursive := true) FROM w) p ON p.g = d.g AND p.id = d.i
                       JOIN (SELECT g, unnest(members, recursive := true) FROM w) q ON q.g = d.g AND q.id = d.j
                WHERE p.c <> q.c GROUP BY ALL
            ) WHERE dist < 0.9 GROUP BY g
        ) USING (g) WHERE w.merged
    ), ended AS (SELECT g, unnest(arg_max(members, step), recursive := true) FROM w GROUP BY g)
"""


@query(f"""
    WITH RECURSIVE v AS (SELECT label || '-' || vec_id % 10 AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    d AS (SELECT a.g, a.id AS i, b.id AS j, 1 - list_cosine_similarity(a.x, b.x) AS diff FROM v a JOIN v b ON a.g = b.g AND a.id < b.id), {LINKAGE_SQL}
    SELECT g AS video, id AS track_id, CASE WHEN count(*) OVER (PARTITION BY g) > 1 THEN CAST(dense_rank() OVER (PARTITION BY g ORDER BY c) - 1 AS INTEGER) END AS character_id FROM ended
""")
def q20_complete_linkage(spark, sf_dir):
    own = crops(spark, sf_dir).withColumn("video", F.concat_ws("-", "label", "track_id"))
    differences = identity.crop_differences(own.select("video", "vec_id", "feature"), ["video"], "vec_id", below=0.9)
    tracks = own.select("video", F.col("vec_id").alias("track_id"))
    return identity.assign_characters(tracks, differences, 0.9, known=identity.cropped(own, ["video"], "vec_id"))


@query(on_events(f""", seen AS (
        SELECT DISTINCT e.video, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM ev e JOIN embeddings ON vec_id = user_id
    ), users AS (SELECT DISTINCT video, CAST(floor(t / 3600) AS BIGINT) AS k, user_id AS id FROM ev),
    apart AS (SELECT a.video, a.id AS i, b.id AS j, 1 - list_cosine_similarity(a.x, b.x) AS diff FROM seen a JOIN seen b ON a.video = b.video AND a.id < b.id),
    v AS (SELECT video || '|' || k AS g, id FROM users SEMI JOIN seen USING (video, id)),
    d AS (SELECT a.g, a.id AS i, b.id AS j, diff FROM v a JOIN v b ON a.g = b.g AND a.id < b.id JOIN apart ON apart.video = split_part(a.g, '|', 1) AND apart.i = a.id AND apart.j = b.id), {LINKAGE_SQL}
    SELECT video, k, count(DISTINCT c) AS n FROM (SELECT DISTINCT video, k, video || '|' || k AS g FROM users) LEFT JOIN ended USING (g) GROUP BY video, k
""", True))
def q21_window_scope_count(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("string").alias("video"), F.col("vec_id").alias("track_id"), F.col("embedding").alias("feature"))
    users = domain.events(spark, sf_dir).select("video", F.floor(F.col("t") / 3600).cast("long").alias("k"), F.col("user_id").alias("track_id")).distinct()
    seen = users.select("video", "track_id").distinct()
    shown = vectors.join(seen, ["video", "track_id"], "left_semi")
    return identity.window_scope_counts_of_crops(users, shown, 0.9)


BOXES = "SELECT l_orderkey AS frame, l_linenumber AS n, l_quantity AS x1, l_linenumber * 5.0 AS y1, l_quantity + 20 AS x2, l_linenumber * 5.0 + 20 AS y2, l_extendedprice AS score FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_linenumber") * 5.0
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("x1"), y.alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (y + 20).alias("y2"), F.col("l_extendedprice").alias("score"))


@query(f"""
    WITH b AS ({BOXES}), p AS (
        SELECT a.frame, CAST(a.n AS BIGINT) AS i, CAST(b.n AS BIGINT) AS j, a.x1 AS ax, b.x1 AS bx,
               CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS DOUBLE) * CAST(greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS s
        FROM b a JOIN b ON a.frame = b.frame AND (a.n < b.n OR (a.n = b.n AND a.x1 < b.x1))
    )
    SELECT frame, i, j, count(*) AS pairs, max(CAST(floor(s / (800 - s) * 1000 + 0.000001) AS BIGINT)) AS milli FROM p GROUP BY ALL
""")
def q22_iou_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    left = b.select("frame", F.col("n").alias("i"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    right = b.select("frame", F.col("n").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = left.join(right, "frame").filter("i < j OR (i = j AND a_x1 < b_x1)")
    milli = F.floor(geometry.iou(geometry.box("a_"), geometry.box("b_")) * 1000 + 0.000001).cast("long")
    return pairs.groupBy("frame", "i", "j").agg(F.count(F.lit(1)).alias("pairs"), F.max(milli).alias("milli"))


@query(f"""
    WITH RECURSIVE b AS ({BOXES}),
    o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, x1, y1, x2, y2) AS r FROM b),
    k AS (
        SELECT frame, r, [struct_pack(x1 := x1, y1 := CAST(y1 AS DOUBLE), x2 := x2, y2 := CAST(y2 AS DOUBLE), score := score)] AS kept FROM o WHERE r = 1
        UNION ALL
        SELECT o.frame, o.r, CASE WHEN len(list_filter(k.kept, lambda e:
            greatest(0, least(e.x2, o.x2) - greatest(e.x1, o.x1)) * greatest(0, least(e.y2, o.y2) - greatest(e.y1, o.y1))
            > 0.4::DOUBLE * ((e.x2 - e.x1) * (e.y2 - e.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(e.x2, o.x2) - greatest(e.x1, o.x1)) * greatest(0, least(e.y2, o.y2) - greatest(e.y1, o.y1))))) > 0
            THEN k.kept ELSE list_append(k.kept, struct_pack(x1 := o.x1, y1 := CAST(o.y1 AS DOUBLE), x2 := o.x2, y2 := CAST(o.y2 AS DOUBLE), score := o.score)) END
        FROM k JOIN o ON o.frame = k.frame AND o.r = k.r + 1
    )
    SELECT frame, u.x1, u.y1, u.x2, u.y2, u.score FROM (SELECT frame, unnest(arg_max(kept, r)) AS u FROM k GROUP BY frame)
""")
def q23_nms(spark, sf_dir):
    return gates.non_max_suppression(boxes(spark, sf_dir), ["frame"])


# A frame of these detections has one box, so matching is with the open track of the highest (IoU, number).
@query(on_events(""", o AS (
        SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY event_id) AS INTEGER) AS r, event_id AS f, event_type AS label, t, event_id % 37 AS x1, event_id % 11 AS y1, event_id % 37 + 20 AS x2, event_id % 11 + event_id % 90 AS y2 FROM ev
    ), w AS (
        SELECT video, 0 AS r, 0 AS next_id, CAST([] AS STRUCT(id INTEGER, f BIGINT, label VARCHAR, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) AS live, NULL::INTEGER AS track_id, NULL::VARCHAR AS label, NULL::DOUBLE AS t FROM (SELECT DISTINCT video FROM o)
        UNION ALL
        SELECT video, r, CASE WHEN hit IS NULL THEN next_id + 1 ELSE next_id END,
               CASE WHEN hit IS NULL THEN list_append(open, struct_pack(id := next_id, f := f, label := label, x1 := x1, y1 := y1, x2 := x2, y2 := y2))
                    ELSE list_transform(open, lambda e: CASE WHEN e.id = hit.id THEN struct_pack(id := e.id, f := f, label := label, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ELSE e END) END,
               coalesce(hit.id, next_id), label, t
        FROM (
            SELECT *, list_sort(list_filter(list_transform(list_filter(open, lambda e: e.label = label), lambda e: struct_pack(
                share := coalesce(greatest(0, least(e.x2, x2) - greatest(e.x1, x1)) * greatest(0, least(e.y2, y2) - greatest(e.y1, y1)) / CAST(nullif((e.x2 - e.x1) * (e.y2 - e.y1) + (x2 - x1) * (y2 - y1)
                    - greatest(0, least(e.x2, x2) - greatest(e.x1, x1)) * greatest(0, least(e.y2, y2) - greatest(e.y1, y1)), 0) AS DOUBLE), 0), id := e.id)), lambda s: s.share >= 0.3::DOUBLE), 'DESC')[1] AS hit
            FROM (SELECT o.*, w.next_id, list_filter(w.live, lambda e: o.f - e.f - 1 <= 1) AS open FROM w JOIN o ON o.video = w.video AND o.r = w.r + 1)
        )
    )
    SELECT video, track_id, label, min(t) AS start_time, max(t) AS end_time, CAST(count(*) AS INTEGER) AS num_detections FROM w WHERE r > 0 GROUP BY ALL""", True))
def q24_box_tracker(spark, sf_dir):
    return tracking.tracks_of(tracking.track_boxes(detections(spark, sf_dir), Config()))


@query("SELECT user_id, count(*) FILTER (value > 250) AS n_3d, count(*) AS total, CASE WHEN 2 * count(*) FILTER (value > 250) > count(*) THEN '3d' ELSE '2d' END AS style FROM events GROUP BY user_id")
def q25_majority_style(spark, sf_dir):
    return evaluation.majority_style(table(spark, sf_dir, "events").withColumn("is_3d", F.col("value") > 250), "user_id")


@query("""
    WITH e AS (SELECT user_id, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS a, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS b FROM events GROUP BY user_id)
    SELECT user_id, b <> 0 AND a / b < 0.5 AS is_real, b <> 0 AND a / b BETWEEN 0.45 AND 0.8 AS is_ambiguous FROM e
""")
def q26_evidence_ratio(spark, sf_dir):
    return evaluation.evidence_ratio(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "click", "view").select("user_id", "is_real", "is_ambiguous")


TRUTH_NAME = "'films/魔女之旅_' || doc_id || 's（人脸数期望：' || doc_id % 5 || '+' || doc_id % 7 || '）（跨镜头身份去重后期望：' || doc_id % 11 || '）.mp4'"


@query("""
    SELECT CAST(doc_id AS INTEGER) AS source_offset, CAST(doc_id % 5 + doc_id % 7 AS INTEGER) AS total_faces, CAST(2 AS INTEGER) AS num_shots, CAST(doc_id % 11 AS INTEGER) AS num_characters, '2d' AS style, '魔女之旅' AS title FROM documents
""")
def q27_truth_from_names(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.expr(TRUTH_NAME).alias("path"))
    return evaluation.parse_truth(names, {"魔女之旅": "2d"}).select("source_offset", "total_faces", "num_shots", "num_characters", "style", "title")


@query("""
    WITH r AS (SELECT lang, source, n_chars % 13 AS p, doc_id % 11 AS g FROM documents)
    SELECT lang, source, count(*) AS n, CAST(round(avg(CASE WHEN g <= 0 THEN 1 ELSE least(p, g) / g::DOUBLE END) * 1000000) AS BIGINT) AS macro_recall,
           CAST(round(sum(least(p, g)) / CAST(nullif(sum(g), 0) AS DOUBLE) * 1000000) AS BIGINT) AS micro_recall, count(*) FILTER (p > g) AS over_detected,
           CAST(round(avg(CASE WHEN p + g = 0 THEN 1 ELSE 2.0::DOUBLE * least(p, g) / (p + g) END) * 1000000) AS BIGINT) AS macro_f1
    FROM r GROUP BY GROUPING SETS ((lang), (lang, source))
""")
def q28_recall_f1_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") % 13).alias("predicted"), (F.col("doc_id") % 11).alias("truth"))
    out = evaluation.metric_rollup(rows, ["lang"], ["source"])
    return out.select("lang", "source", "n", *(F.round(F.col(c) * 1000000).cast("long").alias(c) for c in ("macro_recall", "micro_recall")), "over_detected", F.round(F.col("macro_f1") * 1000000).cast("long").alias("macro_f1"))


@query("""
    WITH g AS (SELECT lang, n_chars % 5 AS threshold, CAST(max(doc_id % 3) AS BIGINT) AS f1 FROM documents GROUP BY ALL)
    SELECT lang, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold DESC) AS r FROM g) WHERE r = 1
""")
def q29_best_threshold(spark, sf_dir):
    grid = table(spark, sf_dir, "documents").groupBy("lang", (F.col("n_chars") % 5).alias("threshold")).agg(F.max(F.col("doc_id") % 3).alias("f1"))
    return evaluation.best_threshold(grid, ["lang"], prefer="highest").select("lang", "threshold", "f1")


@query("""
    WITH c AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT c_nationkey, list_sort(list(n)) AS counts, CAST(sum(n) AS BIGINT) AS duration FROM c GROUP BY c_nationkey)
    SELECT c_nationkey AS nation, len(counts) AS segments, CAST(floor(duration / 30) AS BIGINT) AS max_windows, counts[len(counts) // 2 + 1] AS median_count, list_max(counts) AS max_count FROM r
""")
def q30_run_summary(spark, sf_dir):
    each = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count(F.lit(1)).alias("n"))
    runs = each.groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_list("n").alias("counts"), F.sum("n").alias("duration")).withColumn("window_seconds", F.lit(30.0))
    return evaluation.run_summary(runs).select("nation", F.col("segments").cast("long").alias("segments"), "max_windows", "median_count", "max_count")


STATUS = "CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'done' END"


@query(f"""
    WITH s AS (SELECT o_custkey, {STATUS} AS status FROM orders)
    SELECT o_custkey, CASE WHEN bool_or(status IN ('queued', 'running')) THEN 'running' WHEN bool_and(status = 'cancelled') THEN 'cancelled'
        WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'done' END AS status FROM s GROUP BY o_custkey
""")
def q31_status_rollup(spark, sf_dir):
    return catalog.status_rollup(table(spark, sf_dir, "orders").withColumn("status", F.expr(STATUS)), "o_custkey")


@query("""
    SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'idle') AS status FROM customer LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders
    ) ON o_custkey = c_custkey AND r = 1
""")
def q32_latest_child(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    out = catalog.latest_child(parents, table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return out.select("c_custkey", "o_orderkey", F.coalesce("o_orderstatus", F.lit("idle")).alias("status"))


@query("""
    SELECT event_id, CAST(round_even(100 * (CASE event_id % 4 WHEN 0 THEN 0.1::DOUBLE * f WHEN 1 THEN 0.1::DOUBLE + 0.75::DOUBLE * f WHEN 2 THEN 0.85::DOUBLE + 0.1::DOUBLE * f ELSE 0.95::DOUBLE + 0.05::DOUBLE * f END), 0) AS INTEGER) AS percent
    FROM (SELECT event_id, least(1, greatest(0, value / 400)) AS f FROM events)
""")
def q33_progress_percent(spark, sf_dir):
    stages = F.array(*(F.lit(s) for s, _ in catalog.STAGE_WEIGHTS))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(stages, (F.col("event_id") % 4).cast("int")).alias("stage"), (F.col("value") / 400).alias("fraction"))
    return catalog.progress_percent(rows).select("event_id", "percent")


@query("""
    SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)
""")
def q34_name_dedup(spark, sf_dir):
    return catalog.distinct_names(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS at FROM events),
    s AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) AS r FROM s) WHERE r <= 5),
    p AS (SELECT *, unnest(range(0, 4)) AS place FROM top)
    SELECT p.event_type, p.user_id, CAST(place AS INTEGER) AS place, e.event_id FROM p JOIN e ON e.event_type = p.event_type AND e.user_id = p.user_id
        AND e.at = least(n - 1, CAST(floor(place * greatest(1.0::DOUBLE, n / 4.0::DOUBLE)) AS BIGINT))
""")
def q35_contact_sheet(spark, sf_dir):
    return evaluation.gallery(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id", 5, 4).select("event_type", "user_id", "place", "event_id")


@query(on_events("SELECT video, count(*) FILTER (n >= 4) AS x4, count(*) FILTER (n >= 6) AS x6, count(*) FILTER (n >= 8) AS x8 FROM scan GROUP BY video"))
def q36_sweep_pivot(spark, sf_dir):
    rows = windows.sensitivity(scan(spark, sf_dir), [4, 6, 8], ["video"]).withColumn("x", F.concat(F.lit("x"), F.col("x").cast("string")))
    return rows.groupBy("video").pivot("x", ["x4", "x6", "x8"]).agg(F.first("hits"))


@query(on_events(""", shown AS (
        SELECT w.video, w.k, r.character_id, sum(num_detections * 3600) AS s
        FROM windows w JOIN tracks r ON r.video = w.video AND r.start_time < w.t + 21600 AND r.end_time >= w.t GROUP BY ALL
    ) SELECT 'all' AS scope, count(*) AS total FROM shown UNION ALL SELECT 'gated', count(*) FILTER (s >= 7200) FROM shown"""))
def q37_scope_totals(spark, sf_dir):
    videos, tracks = domain.videos(spark, sf_dir), domain.tracks(spark, sf_dir)
    wide = windows.window_scan(videos, tracks, LENGTH, STEP).agg(F.sum("n").alias("all")).crossJoin(F.broadcast(windows.window_scan(videos, tracks, LENGTH, STEP, 7200.0).agg(F.sum("n").alias("gated"))))
    return wide.unpivot([], ["all", "gated"], "scope", "total")


@query(r"""
    WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
    s AS (SELECT page_id, regexp_replace(regexp_replace(base, '^(\.*[^.].*)\.[^.]*$', '\1'), '[/:*?"<>|\r\n\t]', '_', 'g') AS stem FROM b)
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(stem, '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g'), ''), 'video') AS stem FROM s
""")
def q38_safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


@query(on_events("""SELECT track_id, printf('%02dm%02ds', CAST(floor(d) AS BIGINT) // 60, CAST(floor(d) AS BIGINT) % 60) AS stamp,
    printf('%02d:%02d', CAST(floor(d + 0.5) AS BIGINT) // 60, CAST(floor(d + 0.5) AS BIGINT) % 60) AS clock FROM (SELECT track_id, end_time - start_time AS d FROM tracks)"""))
def q39_stamp_clock(spark, sf_dir):
    d = F.col("end_time") - F.col("start_time")
    return domain.tracks(spark, sf_dir).select("track_id", text.stamp(d).alias("stamp"), text.clock(d).alias("clock"))


@query(on_events(f"""{GRID_CANDIDATES}
    SELECT c.video, CAST(round(c.start * 1000000) AS BIGINT) AS start_us, 'v' || c.video || '/v' || c.video || '_' || printf('%02dm%02ds', CAST(floor(c.start) AS BIGINT) // 60, CAST(floor(c.start) AS BIGINT) % 60)
        || '_' || c.character_count || '人.mp4' AS entry FROM walk w JOIN cand c USING (video, k)""", True))
def q40_clip_plan(spark, sf_dir):
    stems = domain.videos(spark, sf_dir).select("video", F.concat(F.lit("v"), F.col("video")).alias("stem"))
    return selection.clip_plan(chosen(spark, sf_dir, False), stems).select("video", micros("start").alias("start_us"), "entry")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey % 600) AS BIGINT) AS seconds, CAST(sum(o_custkey) AS BIGINT) AS bytes FROM orders")
def q41_library_totals(spark, sf_dir):
    assets = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 600).alias("duration"), F.col("o_custkey").alias("size"))
    return catalog.library_totals(assets).select("n", "seconds", "bytes")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q42_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, user_id FROM events ORDER BY md5('0:' || event_id) LIMIT 100")
def q43_reservoir_sample(spark, sf_dir):
    return catalog.reservoir(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, key="event_id")


@query("""
    SELECT user_id, 'both' AS side FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')
    UNION ALL SELECT user_id, 'either' FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'error')
""")
def q44_set_operations(spark, sf_dir):
    users = table(spark, sf_dir, "events")
    a, b = (users.filter(F.col("event_type") == kind).select("user_id") for kind in ("click", "error"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.union(b).distinct().withColumn("side", F.lit("either")))


@query(on_events("SELECT CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL"))
def q45_tumbling_days(spark, sf_dir):
    return domain.events(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
    WITH d AS (SELECT p_partkey, p_size AS x1, p_size % 7 AS y1, p_size + 20 AS x2, p_size % 7 + 30 AS y2 FROM part), e AS (
        SELECT p_partkey, x1 - round_even((x2 - x1) * 0.2::DOUBLE, 0) AS x1, y1 - round_even((y2 - y1) * 0.2::DOUBLE, 0) AS y1, x2 + round_even((x2 - x1) * 0.2::DOUBLE, 0) AS x2, y2 + round_even((y2 - y1) * 0.2::DOUBLE, 0) AS y2 FROM d
    )
    SELECT p_partkey, CAST(greatest(0, x1) AS INTEGER) AS x1, CAST(greatest(0, y1) AS INTEGER) AS y1, CAST(least(60, x2) AS INTEGER) AS x2, CAST(least(33, y2) AS INTEGER) AS y2 FROM e WHERE least(60, x2) > greatest(0, x1)
""")
def q46_expand_and_clamp(spark, sf_dir):
    size = F.col("p_size")
    b = (size, size % 7, size + 20, size % 7 + 30)
    grown = geometry.clamp_box(geometry.expand_box(b, 0.2), F.lit(60), F.lit(33))
    return table(spark, sf_dir, "part").select("p_partkey", grown.alias("b")).filter("b IS NOT NULL").select("p_partkey", "b.x1", "b.y1", "b.x2", "b.y2")
