"""How frontal a face is, from landmarks or from boxes of eyes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the eye span by which nose or mouth may be off before the score is 0.
OFF_AXIS = 0.45
#: Scores without eyes and with one eye; span of the eyes and offset that count in full, in crop widths.
NO_EYE, ONE_EYE, FULL_SPAN, FULL_OFFSET = 0.05, 0.30, 0.40, 0.30


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def frontal_from_landmarks(landmarks: str) -> Column:
    """From 5 points (eyes, nose, corners of the mouth): how near nose and mouth lie to the middle of the eyes.

    Offsets are taken along the line through the eyes and in units of their distance, so the
    score does not depend on rotation or scale.  Null or misshapen landmarks give 1, eyes
    that coincide 0.
    """

    def at(k: int, c: int) -> Column:
        return F.get(F.get(F.col(landmarks), k), c)

    ex, ey = at(1, 0) - at(0, 0), at(1, 1) - at(0, 1)
    span = F.sqrt(ex * ex + ey * ey)
    mx, my = (at(0, 0) + at(1, 0)) / 2, (at(0, 1) + at(1, 1)) / 2

    def off(x: Column, y: Column) -> Column:
        return F.abs(((x - mx) * ex + (y - my) * ey) / span) / span

    nose, mouth = off(at(2, 0), at(2, 1)), off((at(3, 0) + at(4, 0)) / 2, (at(3, 1) + at(4, 1)) / 2)
    shaped = F.col(landmarks).isNotNull() & (F.size(landmarks) == 5) & F.forall(landmarks, lambda p: F.coalesce(F.size(p) == 2, F.lit(False)))
    score = F.when(span < 1e-6, F.lit(0.0)).otherwise(clip01(1 - (nose + mouth) / 2 / OFF_AXIS))
    return F.when(F.coalesce(shaped, F.lit(False)), score).otherwise(F.lit(1.0))


def frontal_from_eyes(eyes: str, width: str) -> Column:
    """From eye boxes (structs x1, y1, x2, y2, score) in a crop: the two best count by their span and their middle."""
    best = F.slice(F.array_sort(F.transform(eyes, lambda e: F.struct((-e["score"]).alias("s"), ((e["x1"] + e["x2"]) / 2).alias("x")))), 1, 2)
    a, b = F.get(best, 0)["x"], F.get(best, 1)["x"]
    span, offset = F.abs(a - b) / F.col(width), F.abs((a + b) / 2 / F.col(width) - 0.5)
    two = clip01(span / FULL_SPAN) * clip01(1 - offset / FULL_OFFSET)
    n = F.coalesce(F.size(eyes), F.lit(0))
    return F.when((n <= 0) | (F.col(width) <= 0), F.lit(NO_EYE)).when(n == 1, F.lit(ONE_EYE)).otherwise(two)


def representative_score(blur: Column, confidence: Column, frontal: Column, weight: float | Column) -> Column:
    """Sharpness times confidence, drawn towards frontal faces by ``weight``; a null sharpness is 0, a null frontal score does not count."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.coalesce(blur, F.lit(0.0)) * confidence * (F.lit(1.0) - w + w * F.coalesce(frontal, F.lit(1.0)))
