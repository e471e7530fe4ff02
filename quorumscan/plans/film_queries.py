"""Queries over mixed styles, raw detector levels, scopes and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumscan.config import Config
from quorumscan.functions import frontal, geometry, metrics, text
from quorumscan.operators import anchors, evaluation, gates, identity, style, windows
from quorumscan.plans import domain
from quorumscan.plans.domain import LENGTH, STEP, table
from quorumscan.plans.pipeline import sweep
from quorumscan.plans.queries import LINKAGE_SQL, on_events, query
from quorumscan.sources import media

GATED_SQL = """, shown AS (
        SELECT w.video, w.k, r.character_id, sum(num_detections * 3600) AS s
        FROM windows w JOIN tracks r ON r.video = w.video AND r.start_time < w.t + 21600 AND r.end_time >= w.t GROUP BY ALL
    ), counts AS (
        SELECT w.video, w.k, count(s.character_id) AS n, count(*) FILTER (s >= 7200) AS gated FROM windows w LEFT JOIN shown s USING (video, k) GROUP BY ALL
    )"""


def counts(spark, sf_dir):
    """(video, k, n, gated): characters of each window, and those that are shown long enough."""
    videos, tracks = domain.videos(spark, sf_dir), domain.tracks(spark, sf_dir)
    gated = windows.window_scan(videos, tracks, LENGTH, STEP, 7200.0).select("video", "k", F.col("n").alias("gated"))
    return windows.window_scan(videos, tracks, LENGTH, STEP).select("video", "k", "n").join(gated, ["video", "k"])


@query(on_events(GATED_SQL + """, films AS (
        SELECT video, CAST(floor(duration / 21600) AS BIGINT) AS m, count(*) FILTER (n >= 6) AS a, count(*) FILTER (gated >= 6) AS g FROM counts JOIN videos USING (video) GROUP BY ALL
    ) SELECT scope, CAST(sum(seg) AS BIGINT) AS segments, CAST(sum(m) AS BIGINT) AS max_windows, CAST(floor(100000.0::DOUBLE * sum(seg) / greatest(sum(m), 1) + 0.5) AS BIGINT) AS milli
    FROM (SELECT 'all' AS scope, a AS seg, m FROM films UNION ALL SELECT 'gated', g, m FROM films) GROUP BY scope"""))
def q66_scope_shares(spark, sf_dir):
    films = counts(spark, sf_dir).groupBy("video").agg(F.count_if(F.col("n") >= 6).alias("segments_all"), F.count_if(F.col("gated") >= 6).alias("segments_gated"))
    films = films.join(domain.videos(spark, sf_dir), "video").withColumn("max_windows", F.floor(F.col("duration") / LENGTH).cast("long"))
    found = evaluation.scope_totals(films, ["all", "gated"])
    return found.select("scope", "segments", "max_windows", F.floor(F.col("percent") * 1000 + 0.5).cast("long").alias("milli"))


@query(on_events(GATED_SQL + """, rated AS (
        SELECT 'all' AS scope, n AS g, n AS p FROM counts UNION ALL SELECT 'gated', n, gated FROM counts UNION ALL SELECT 'short', n, n // 2 FROM counts WHERE k % 3 = 0
    ) SELECT scope, count(*) AS n, CAST(floor(avg(CASE WHEN p + g = 0 THEN 1 ELSE 2.0::DOUBLE * least(p, g) / (p + g) END) * 1000000 + 0.5) AS BIGINT) AS f1,
             CAST(floor(avg(CASE WHEN g <= 0 THEN 1 ELSE least(p, g) / g::DOUBLE END) * 1000000 + 0.5) AS BIGINT) AS recall FROM rated GROUP BY scope"""))
def q67_scope_macro(spark, sf_dir):
    rows = counts(spark, sf_dir).select("n", F.col("n").alias("pred_all"), F.col("gated").alias("pred_gated"), F.when(F.col("k") % 3 == 0, F.floor(F.col("n") / 2)).alias("pred_short"))
    found = evaluation.scope_macro(rows, ["all", "gated", "short"], "n")
    return found.select("scope", "n", *(F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(a) for c, a in (("macro_f1", "f1"), ("macro_recall", "recall"))))


#: Levels of a detector with an input of 64 pixels, made of the vectors: numbers of strides, scores, distances and landmarks.
SIDE, STRIDES = 64, (8, 16, 32)


def raw_levels(spark, sf_dir):
    """By stride: every vector as a frame whose raw scores, distances and landmarks are its numbers, over and over."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("width", (100 + F.col("vec_id") % 50).cast("int")).withColumn("height", F.lit(80))

    def number(i, step, shift):
        return F.abs(F.get("embedding", ((i * step + shift) % 64).cast("int")).cast("double"))

    def level(stride):
        n = (SIDE // stride) ** 2 * anchors.ANCHORS

        def many(each, step, shift, factor):
            return F.transform(F.sequence(F.lit(0), F.lit(each * n - 1)), lambda i: number(i, step, shift + stride) * factor)

        return vectors.select("vec_id", "width", "height", many(1, 1, 0, 3.0).alias("scores"), many(4, 7, 3, 9.0).alias("distances"), many(10, 5, 1, 2.0).alias("landmarks"))

    return {s: level(s) for s in STRIDES}


LEVEL_SQL = """
        SELECT vec_id, {begin} + q AS ord, score, ((q // 2) % {side} * {stride}.0::DOUBLE - e[(q * 4 * 7 + 3 + {stride}) % 64 + 1] * 9.0::DOUBLE * {stride}.0::DOUBLE) / scale AS x1,
               ((q // 2) // {side} * {stride}.0::DOUBLE - e[((q * 4 + 1) * 7 + 3 + {stride}) % 64 + 1] * 9.0::DOUBLE * {stride}.0::DOUBLE) / scale AS y1,
               ((q // 2) % {side} * {stride}.0::DOUBLE + e[((q * 4 + 2) * 7 + 3 + {stride}) % 64 + 1] * 9.0::DOUBLE * {stride}.0::DOUBLE) / scale AS x2,
               ((q // 2) // {side} * {stride}.0::DOUBLE + e[((q * 4 + 3) * 7 + 3 + {stride}) % 64 + 1] * 9.0::DOUBLE * {stride}.0::DOUBLE) / scale AS y2,
               ((q // 2) % {side} * {stride}.0::DOUBLE + e[((q * 10 + 4) * 5 + 1 + {stride}) % 64 + 1] * 2.0::DOUBLE * {stride}.0::DOUBLE) / scale AS nose
        FROM (SELECT vec_id, e, scale, q, e[(q + {stride}) % 64 + 1] * 3.0::DOUBLE AS score FROM v, range(0, {n}) AS r(q)) WHERE score >= 0.6::DOUBLE
"""


@query(f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e, 64.0::DOUBLE / greatest(100 + vec_id % 50, 80) AS scale FROM embeddings
    ), b AS ({" UNION ALL ".join(LEVEL_SQL.format(begin=begin, stride=s, side=64 // s, n=(64 // s) ** 2 * 2) for s, begin in zip(STRIDES, (0, 128, 160), strict=True))}),
    o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS r FROM b),
    k AS (
        SELECT vec_id, r, [struct_pack(score := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2, nose := nose)] AS kept FROM o WHERE r = 1
        UNION ALL
        SELECT o.vec_id, o.r, CASE WHEN len(list_filter(k.kept, lambda e:
            greatest(0, least(e.x2, o.x2) - greatest(e.x1, o.x1)) * greatest(0, least(e.y2, o.y2) - greatest(e.y1, o.y1))
            > 0.4::DOUBLE * ((o.x2 - o.x1) * (o.y2 - o.y1) + (e.x2 - e.x1) * (e.y2 - e.y1) - greatest(0, least(e.x2, o.x2) - greatest(e.x1, o.x1)) * greatest(0, least(e.y2, o.y2) - greatest(e.y1, o.y1))))) > 0
            THEN k.kept ELSE list_append(k.kept, struct_pack(score := o.score, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, nose := o.nose)) END
        FROM k JOIN o ON o.vec_id = k.vec_id AND o.r = k.r + 1
    )
    SELECT vec_id, CAST(trunc(u.x1) AS INTEGER) AS x1, CAST(trunc(u.y1) AS INTEGER) AS y1, CAST(trunc(u.x2) AS INTEGER) AS x2, CAST(trunc(u.y2) AS INTEGER) AS y2,
           CAST(floor(u.score * 1000000) AS BIGINT) AS micro, CAST(floor(u.nose * 1000) AS BIGINT) AS nose_milli
    FROM (SELECT vec_id, unnest(arg_max(kept, r)) AS u FROM k GROUP BY vec_id)
""")
def q68_detector_levels(spark, sf_dir):
    found = anchors.detections_of(raw_levels(spark, sf_dir), ["vec_id"], 0.6, size=SIDE)
    nose = F.get(F.get("landmarks", F.lit(2)), F.lit(0))
    return found.select("vec_id", "x1", "y1", "x2", "y2", F.floor(F.col("confidence") * 1000000).cast("long").alias("micro"), F.floor(nose * 1000).cast("long").alias("nose_milli"))


STYLES = {"0": "2d", "1": "3d", "2": "real"}
STYLE_SQL = "CASE video WHEN '0' THEN '2d' WHEN '1' THEN '3d' WHEN '2' THEN 'real' END"


def styled_videos(spark, sf_dir):
    named = F.coalesce(*(F.when(F.col("video") == v, F.lit(s)) for v, s in STYLES.items()))
    return style.styled(domain.videos(spark, sf_dir).withColumn("style", named), Config(crop_margin=0.1))


@query(on_events(f"""SELECT video, {STYLE_SQL} AS style, count(*) AS n, count(*) FILTER (
        (event_id % 11 + event_id % 90) - event_id % 11 >= CASE video WHEN '0' THEN 0.03::DOUBLE WHEN '1' THEN 0.045::DOUBLE WHEN '2' THEN 0.09::DOUBLE ELSE 0.045::DOUBLE END * 800 AND value >= 50) AS kept
    FROM ev GROUP BY video"""))
def q69_style_gates(spark, sf_dir):
    e = domain.events(spark, sf_dir)
    boxes = e.select("video", F.lit(0.9).alias("confidence"), (F.col("event_id") % 11).alias("y1"), (F.col("event_id") % 11 + F.col("event_id") % 90).alias("y2"), F.col("value").alias("blur_var"), F.lit(800).alias("frame_height"))
    videos = styled_videos(spark, sf_dir)
    kept = style.styled_records(boxes, videos, Config()).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))
    return videos.select("video", "style").join(kept, "video")


# Each group has a threshold of its own; differences are scaled to the one threshold of the walk.
@query(f"""
    WITH RECURSIVE s AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE label % 4 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.178::DOUBLE END AS bound FROM embeddings),
    v AS (SELECT label || '-' || vec_id % 8 AS g, vec_id AS id, x, bound FROM s),
    d AS (SELECT a.g, a.id AS i, b.id AS j, (1 - list_cosine_similarity(a.x, b.x)) / a.bound * 0.9::DOUBLE AS diff FROM v a JOIN v b ON a.g = b.g AND a.id < b.id), {LINKAGE_SQL}
    SELECT g AS video, count(*) AS n, count(DISTINCT c) AS characters FROM ended GROUP BY g HAVING count(*) > 1
""")
def q70_style_thresholds(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.concat_ws("-", F.col("label"), F.col("vec_id") % 8).alias("video"), "label", F.col("vec_id").alias("track_id"), F.col("embedding").alias("feature"))
    named = F.coalesce(*(F.when(F.col("label") % 4 == int(v), F.lit(s)) for v, s in STYLES.items()))
    videos = style.styled(vectors.select("video", named.alias("style")).distinct(), Config())
    widest = videos.agg(F.max("identity_threshold")).first()[0]
    apart = style.with_settings(identity.crop_differences(vectors.select("video", "track_id", "feature"), ["video"], below=widest), videos, "identity_threshold")
    known = identity.assign_characters(vectors.select("video", "track_id"), apart, "identity_threshold", known=identity.cropped(vectors, ["video"]))
    return known.filter("character_id IS NOT NULL").groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("character_id").alias("characters"))


@query(r"""
    WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS kind, p_size AS s FROM part), b AS (
        SELECT k, kind, s, greatest(0, s - g) AS x1, greatest(0, 3 - g) AS y1, least(60, s + 20 + g) AS x2, least(40, 23 + g) AS y2 FROM (SELECT *, CAST(round_even(20 * 0.1::DOUBLE, 0) AS INTEGER) AS g FROM p)
    ), f AS (
        SELECT *, CASE WHEN kind = 0 THEN greatest(0, least(1, 1 - (abs((k % 7) / 20.0::DOUBLE) + abs((k % 5) / 20.0::DOUBLE)) / 2 / 0.45::DOUBLE)) ELSE 1 END AS frontal FROM b
    ) SELECT k, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 * 1000000 + y1 * 10000 + x2 * 100 + y2 END AS crop, CAST(floor(frontal * 1000000 + 0.5) AS BIGINT) AS frontal_micro FROM f
""")
def q71_detector_hooks(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")

    def point(x, y):
        return F.array(x.cast("double"), F.lit(float(y)))

    marks = F.array(point(F.lit(10), 10), point(F.lit(30), 10), point(20 + k % 7, 20), point(10 + k % 5, 30), point(30 + k % 5, 30))
    boxes = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 3 == 0, F.lit("real_face_scrfd")).otherwise(F.lit("anime_face_imgutils")).alias("detector"),
        size.alias("x1"), F.lit(3).alias("y1"), (size + 20).alias("x2"), F.lit(23).alias("y2"), F.lit(60).alias("frame_width"), F.lit(40).alias("frame_height"), marks.alias("landmarks"),
    )
    c = F.col("crop")
    out = media.with_hooks(boxes, 0.1).select("k", (c["x1"] * 1000000 + c["y1"] * 10000 + c["x2"] * 100 + c["y2"]).cast("long").alias("crop"), F.floor(F.col("frontal") * 1000000 + 0.5).cast("long").alias("frontal_micro"))
    return out


@query(on_events("""SELECT video, track_id, printf('%.2f', CAST(100 * start_time / duration AS DOUBLE)) || '%' AS left_at, printf('%.2f', CAST(100 * (end_time - start_time) / duration AS DOUBLE)) || '%' AS width
    FROM tracks JOIN videos USING (video) WHERE num_detections > 1"""))
def q72_segment_layout(spark, sf_dir):
    rows = domain.tracks(spark, sf_dir).filter("num_detections > 1").join(domain.videos(spark, sf_dir), "video")
    return rows.select("video", "track_id", text.percent_of(F.col("start_time"), F.col("duration")).alias("left_at"), text.percent_of(F.col("end_time") - F.col("start_time"), F.col("duration")).alias("width"))


GRID_SQL = f"""
    WITH RECURSIVE s AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), grid AS (SELECT unnest([0.7::DOUBLE, 0.9::DOUBLE]) AS bound),
    v AS (SELECT label || '-' || vec_id % 8 || '|' || bound AS g, vec_id AS id, x, bound FROM s, grid),
    d AS (SELECT a.g, a.id AS i, b.id AS j, (1 - list_cosine_similarity(a.x, b.x)) / a.bound * 0.9::DOUBLE AS diff FROM v a JOIN v b ON a.g = b.g AND a.id < b.id), {LINKAGE_SQL},
    lone AS (SELECT g FROM v GROUP BY g HAVING count(*) = 1),
    who AS (SELECT split_part(g, '|', 1) AS video, CAST(split_part(g, '|', 2) AS DOUBLE) AS threshold, id, c, id % 50 * 2.0::DOUBLE AS b, id % 50 * 2.0::DOUBLE + 4 AS e FROM ended WHERE g NOT IN (FROM lone)),
    films AS (SELECT DISTINCT label || '-' || vec_id % 8 AS video FROM embeddings),
    ws AS (SELECT video, bound AS threshold, k, k * 2.0::DOUBLE AS t FROM films, grid, range(0, 46) AS r(k)),
    n AS (SELECT w.video, w.threshold, k, count(DISTINCT c) AS n FROM ws w LEFT JOIN who ON who.video = w.video AND who.threshold = w.threshold AND b < t + 10 AND e >= t GROUP BY ALL),
    hit AS (SELECT n.*, x FROM n, (SELECT unnest([2, 3]) AS x) WHERE n >= x),
    walk AS (
        SELECT video, threshold, x, min(k) AS k FROM hit GROUP BY ALL
        UNION ALL
        SELECT w.video, w.threshold, w.x, (SELECT min(h.k) FROM hit h WHERE h.video = w.video AND h.threshold = w.threshold AND h.x = w.x AND h.k >= w.k + 5) FROM walk w WHERE w.k IS NOT NULL
    )
    SELECT video, threshold, CAST(x AS INTEGER) AS x, (SELECT count(DISTINCT c) FROM who WHERE who.video = f.video AND who.threshold = g.bound) AS n_characters,
           (SELECT count(*) FROM walk WHERE walk.video = f.video AND walk.threshold = g.bound AND walk.x = xs.x AND walk.k IS NOT NULL) AS n_segments
    FROM (SELECT f.video, g.bound AS threshold, xs.x FROM films f, grid g, (SELECT unnest([2, 3]) AS x) xs) JOIN films f USING (video) JOIN grid g ON g.bound = threshold JOIN (SELECT unnest([2, 3]) AS x) xs USING (x)
"""


@query(GRID_SQL)
def q73_sweep_grid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.concat_ws("-", F.col("label"), F.col("vec_id") % 8).alias("video"), F.col("vec_id").alias("track_id"), F.col("embedding").alias("feature"))
    start = F.col("track_id") % 50 * 2.0
    tracks = vectors.select("video", "track_id", start.alias("start_time"), (start + 4.0).alias("end_time"), F.lit(3).alias("num_detections"))
    videos = vectors.select("video").distinct().withColumn("duration", F.lit(100.0))
    config = Config(window_seconds=10.0, frame_interval=2.0)
    return sweep(tracks, identity.crop_differences(vectors, ["video"], below=0.9), videos, config, [0.7, 0.9], [2, 3], identity.cropped(vectors, ["video"]))


@query("""
    WITH c AS (SELECT o_custkey AS k, list(CAST(o_orderkey % 9 AS DOUBLE) ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey),
    p AS (SELECT k, v, greatest(6, ceil(list_max(v))) AS top FROM c)
    SELECT k, CAST(len(v) AS INTEGER) AS n, CAST(floor(list_sum(list_transform(v, lambda y, i: (i - 1) * 1000.0::DOUBLE / greatest(1, len(v) - 1))) + 0.5) AS BIGINT) AS xs,
           CAST(floor(list_sum(list_transform(v, lambda y: 56 - y / top * 56.0::DOUBLE)) * 1000 + 0.5) AS BIGINT) AS ys FROM p
""")
def q74_curve_points(spark, sf_dir):
    curves = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 9).cast("double").alias("v")))), lambda s: s["v"]).alias("curve"))
    points = curves.select("k", geometry.curve_points("curve", F.lit(4)).alias("p"))

    def total(name):
        return F.aggregate("p", F.lit(0.0), lambda s, q: s + q[name])

    return points.select("k", F.size("p").alias("n"), F.floor(total("x") + 0.5).cast("long").alias("xs"), F.floor(total("y") * 1000 + 0.5).cast("long").alias("ys"))


@query("""
    WITH v AS (SELECT user_id, 2 * count(*) FILTER (value > 250) > count(*) AS deep FROM events GROUP BY user_id),
    e AS (SELECT user_id, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS a, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS b FROM events GROUP BY user_id),
    r AS (SELECT user_id, deep, CASE WHEN deep AND b <> 0 THEN a / b END AS ratio FROM v JOIN e USING (user_id))
    SELECT user_id, CASE WHEN NOT deep THEN '2d' WHEN ratio < 0.5 THEN 'real' ELSE '3d' END AS style, coalesce(ratio BETWEEN 0.45 AND 0.8, false) AS is_ambiguous FROM r
""")
def q75_style_routing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = F.when(F.col("event_type") == "click", F.lit("anime_face_imgutils")).when(F.col("event_type") == "view", F.lit("real_face_scrfd"))
    evidence = e.select("user_id", names.alias("detector"), F.col("value").alias("confidence"))
    return style.routed(e.select("user_id", (F.col("value") > 250).alias("is_3d")), evidence, Config(), "user_id").select("user_id", "style", "is_ambiguous")


@query("""
    WITH p AS (SELECT p_partkey AS k, p_size AS s, 40 + p_partkey % 60 AS w FROM part), e AS (
        SELECT k, w, s % 4 AS n, [struct_pack(c := 0.9::DOUBLE, x := 8.0::DOUBLE + s % 11), struct_pack(c := 0.5::DOUBLE + k % 3 / 10.0::DOUBLE, x := w - 9.5::DOUBLE), struct_pack(c := 0.2::DOUBLE, x := 1.0::DOUBLE)][:s % 4] AS eyes FROM p
    ), b AS (SELECT *, list_sort(list_transform(eyes, lambda y: struct_pack(c := -y.c, x := y.x))) AS o FROM e), f AS (
        SELECT *, CASE WHEN n = 0 THEN 0.05::DOUBLE WHEN n = 1 THEN 0.3::DOUBLE ELSE
            greatest(0, least(1, abs(o[1].x - o[2].x) / w / 0.4::DOUBLE)) * greatest(0, least(1, 1 - abs((o[1].x + o[2].x) / 2 / w - 0.5::DOUBLE) / 0.3::DOUBLE)) END AS frontal FROM b
    ) SELECT k, CAST(floor(frontal * 1000000 + 0.5) AS BIGINT) AS frontal_micro, n >= 2 AND frontal >= 0.35::DOUBLE AS kept FROM f
""")
def q76_eye_gate(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    width = (40 + k % 60).cast("int")

    def eye(score, x):
        return F.struct((x - 2.0).alias("x1"), F.lit(0.0).alias("y1"), (x + 2.0).alias("x2"), F.lit(2.0).alias("y2"), score.alias("score"))

    eyes = F.array(eye(F.lit(0.9), F.lit(8.0) + size % 11), eye(F.lit(0.5) + k % 3 / F.lit(10.0), width - F.lit(9.5)), eye(F.lit(0.2), F.lit(1.0)))
    crops = table(spark, sf_dir, "part").select(k.alias("k"), width.alias("crop_width"), F.slice(eyes, F.lit(1), (size % 4).cast("int")).alias("eyes"))
    scored = crops.withColumn("frontal", frontal.frontal_from_eyes("eyes", "crop_width")).withColumn("num_eyes", F.size("eyes"))
    kept = gates.passes_frontal(Config(require_eyes=2, min_frontal_score=0.35))
    return scored.select("k", F.floor(F.col("frontal") * 1000000 + 0.5).cast("long").alias("frontal_micro"), kept.alias("kept"))


@query("""
    SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'no video stream' WHEN c_custkey % 3 = 0 THEN 'codec ' || lower(c_mktsegment)
           WHEN NOT contains(CASE WHEN c_custkey % 4 = 0 THEN 'matroska,webm' ELSE 'mov,mp4,m4a' END, 'mp4') THEN 'container matroska,webm'
           WHEN NOT coalesce(c_acctbal, 0) > 0 THEN 'no duration' END AS problem FROM customer
""")
def q77_container_problems(spark, sf_dir):
    k = F.col("c_custkey")
    codec = F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.lower("c_mktsegment")).otherwise(F.lit("h264"))
    container = F.when(k % 4 == 0, F.lit("matroska,webm")).otherwise(F.lit("mov,mp4,m4a"))
    probes = table(spark, sf_dir, "customer").select(k.alias("k"), codec.alias("codec"), container.alias("container"), F.col("c_acctbal").cast("double").alias("duration"))
    return media.valid_containers(probes).select("k", "problem")


@query(on_events("""SELECT user_id, count(*) AS n, CAST(floor(CAST(coalesce(sum(CAST(floor(value * 1000) AS BIGINT)), 0) AS DOUBLE) / nullif(count(*) FILTER (event_type = 'error'), 0)) AS BIGINT) AS ratio_milli,
        CAST(len(list_distinct(list(event_type))) AS INTEGER) AS kinds, CAST(sum(list_sum(list_transform(string_split(event_id % 7 || ', ,' || event_id % 11, ','), lambda x: coalesce(TRY_CAST(trim(x) AS BIGINT), 0)))) AS BIGINT) AS numbers
    FROM ev GROUP BY user_id"""))
def q78_parsed_ratios(spark, sf_dir):
    e = domain.events(spark, sf_dir)
    listed = text.parse_numbers(F.concat_ws(",", F.col("event_id") % 7, F.lit(" "), F.col("event_id") % 11), "long")
    total = F.sum(F.aggregate(listed, F.lit(0).cast("long"), lambda s, x: s + x))
    found = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.floor(F.col("value") * 1000).cast("long")), F.lit(0)).alias("v"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").cast("int").alias("kinds"), total.alias("numbers"))
    return found.select("user_id", "n", F.floor(metrics.count_ratio(F.col("v"), F.col("errors"))).cast("long").alias("ratio_milli"), "kinds", "numbers")
