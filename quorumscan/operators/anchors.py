"""Boxes out of a detector's raw levels: an anchor-based pyramid read as a plan.

A level of a frame has, for each cell of its grid and each anchor of a cell, a score, four distances from the cell's corner to the box's
sides and ten to its five landmarks, all in strides.  Scores are masked before anything is decoded or exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the detector: side of its input, anchors of a cell, landmarks, largest overlap of two boxes.
INPUT_SIZE, ANCHORS, LANDMARKS, OVERLAP = 640, 2, 5, 0.4
BOX = "struct<rank:double,at:int,x1:double,y1:double,x2:double,y2:double,points:array<array<double>>>"


def letterbox_scale(width: Column, height: Column, size: int = INPUT_SIZE) -> Column:
    """By how much a frame is shrunk or stretched so that its longer side fills the input."""
    return F.lit(float(size)) / F.greatest(width, height)


def decoded_level(level: DataFrame, keys: list[str], stride: int, least_score: float, size: int = INPUT_SIZE, anchors: int = ANCHORS) -> DataFrame:
    """Boxes of one level in pixels of its frame: keys, stride, at (the anchor's number), score, x1, y1, x2, y2, points.

    ``level`` has keys, width, height, scores (one for each anchor), distances (four) and landmarks (ten), arrays of numbers.  Cells go
    by rows.  Scores that are null or under ``least_score`` are left out first.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("scores") - 1), lambda i: F.get("scores", i) >= F.lit(float(least_score)))
    kept = level.filter(F.size("scores") > 0).select(*keys, "width", "height", "scores", "distances", "landmarks", F.explode(at).alias("at"))
    cell, side = F.floor(F.col("at") / anchors).cast("int"), size // stride
    x, y = (cell % side) * F.lit(float(stride)), F.floor(cell / side) * F.lit(float(stride))
    scale = letterbox_scale(F.col("width"), F.col("height"), size)

    def reach(name: str, number: int, k: int | Column) -> Column:
        return F.get(name, F.col("at") * number + k).cast("double") * F.lit(float(stride))

    sides = [(x - reach("distances", 4, 0)), (y - reach("distances", 4, 1)), (x + reach("distances", 4, 2)), (y + reach("distances", 4, 3))]
    points = F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda p: F.array((x + reach("landmarks", 2 * LANDMARKS, 2 * p)) / scale, (y + reach("landmarks", 2 * LANDMARKS, 2 * p + 1)) / scale))
    names = ("x1", "y1", "x2", "y2")
    return kept.select(*keys, F.lit(stride).alias("stride"), "at", F.get("scores", F.col("at")).cast("double").alias("score"), *((s / scale).alias(n) for s, n in zip(sides, names, strict=True)), points.alias("points"))


def all_levels(levels: dict[int, DataFrame], keys: list[str], least_score: float, size: int = INPUT_SIZE, anchors: int = ANCHORS) -> DataFrame:
    """The union of all levels by stride, the finest first in the order of anchors: ``order`` numbers them over all levels."""
    begins, begin = {}, 0
    for stride in sorted(levels):
        begins[stride] = begin
        begin += (size // stride) ** 2 * anchors
    parts = [decoded_level(levels[s], keys, s, least_score, size, anchors).withColumn("order", F.col("at") + F.lit(begins[s])) for s in sorted(levels)]
    return reduce(DataFrame.unionByName, parts)


def best_of_overlapping(boxes: DataFrame, keys: list[str], overlap: float = OVERLAP) -> DataFrame:
    """Boxes of each frame, with landmarks, that no better box overlaps by more than ``overlap``; ties go to the lower ``order``.

    A fold over the frame's boxes by falling score.  A frame has few above the least score; frames are spread over tasks.
    """
    item = F.struct((-F.col("score")).alias("rank"), F.col("order").cast("int").alias("at"), "x1", "y1", "x2", "y2", "points")
    shared = "greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1))"
    both = "(b.x2 - b.x1) * (b.y2 - b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1)"
    kept = F.expr(f"aggregate(boxes, cast(array() AS array<{BOX}>), (kept, b) -> if(exists(kept, k -> {shared} > {float(overlap)}D * ({both} - {shared})), kept, concat(kept, array(b))))")
    folded = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).cast(f"array<{BOX}>").alias("boxes"))
    return folded.select(*keys, F.explode(kept).alias("b")).select(*keys, (-F.col("b.rank")).alias("score"), *(F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "points")))


def detections_of(levels: dict[int, DataFrame], keys: list[str], least_score: float, label: str = "face", size: int = INPUT_SIZE, anchors: int = ANCHORS, overlap: float = OVERLAP) -> DataFrame:
    """Raw levels to detections: keys, x1, y1, x2, y2 (whole pixels, cut off towards 0), confidence, label, landmarks."""
    boxes = best_of_overlapping(all_levels(levels, keys, least_score, size, anchors), keys, overlap)
    return boxes.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("score").alias("confidence"), F.lit(label).alias("label"), F.col("points").alias("landmarks"))
