"""Which detections and tracks are good enough to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumscan.config import Config


def passes_quality(config: Config, frame_height: str | Column = "frame_height", ratio: Column | None = None) -> Column:
    """Confidence, height and sharpness reach their bounds; a null sharpness is 0.  ``ratio`` is a least height of each row's own."""
    ratio = F.lit(config.min_face_height_ratio) if ratio is None else ratio
    height = F.col(frame_height) if isinstance(frame_height, str) else frame_height
    return (
        (F.col("confidence") >= config.conf_threshold)
        & (F.col("y2") - F.col("y1") >= ratio * height)
        & (F.coalesce("blur_var", F.lit(0.0)) >= config.blur_var_threshold)
    )


def passes_frontal(config: Config) -> Column:
    """Enough eyes and frontal enough; each gate is off at 0."""
    eyes = F.lit(True) if config.require_eyes <= 0 else F.coalesce(F.col("num_eyes") >= config.require_eyes, F.lit(False))
    frontal = F.lit(True) if config.min_frontal_score <= 0 else F.coalesce(F.col("frontal") >= config.min_frontal_score, F.lit(False))
    return eyes & frontal


def detection_records(detections: DataFrame, config: Config) -> DataFrame:
    """Every detection with ``kept``: whether it passes all gates.  Cheap gates come first."""
    return detections.withColumn("kept", F.coalesce(passes_quality(config) & passes_frontal(config), F.lit(False)))


def drop_short_tracks(tracks: DataFrame, seconds: float) -> DataFrame:
    """Tracks that last ``seconds`` or more between their first and last sample."""
    return tracks if seconds <= 0 else tracks.filter(F.col("end_time") - F.col("start_time") >= seconds)


def non_max_suppression(boxes: DataFrame, keys: list[str], threshold: float = 0.4) -> DataFrame:
    """Boxes (x1, y1, x2, y2, score) of each frame that no better box overlaps beyond ``threshold``.

    A fold over the frame's boxes by falling score, ties by x1, y1, x2, y2: a box stays unless its IoU with
    one that stayed exceeds the threshold.  A frame's boxes are few; frames are spread over tasks.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "x1", "y1", "x2", "y2")))
    box = "struct<rank:double,x1:double,y1:double,x2:double,y2:double>"
    overlap = """
        (greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1)))
    """
    area = "((b.x2 - b.x1) * (b.y2 - b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1))"
    kept = F.expr(f"""
        aggregate(cast(boxes AS array<{box}>), cast(array() AS array<{box}>), (kept, b) ->
            if(exists(kept, k -> {overlap} > {threshold}D * ({area} - {overlap})), kept, concat(kept, array(b))))
    """)
    return boxes.groupBy(*keys).agg(ordered.alias("boxes")).select(*keys, F.explode(kept).alias("b")).select(*keys, "b.x1", "b.y1", "b.x2", "b.y2", (-F.col("b.rank")).alias("score"))
