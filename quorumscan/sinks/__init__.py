"""Sinks: records rounded for reports, and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _rounded(values: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(p)) for v, p in zip(values, places, strict=True)], dtype="float64")


def rounded(column: Column | str, places: int) -> Column:
    """A number rounded as reports round: the exact binary value, halves to even (2.675 gives 2.67).

    Spark's own functions round the shortest decimal form instead, so this is an Arrow function; it is for what leaves the engine.
    """
    return _rounded(F.col(column) if isinstance(column, str) else column, F.lit(places))


def detection_records(detections: DataFrame) -> DataFrame:
    """Detections as they are reported: time to 3, confidence to 4, sharpness to 2, frontal to 3 places."""
    places = {"time": 3, "confidence": 4, "blur_var": 2, "frontal": 3}
    return detections.select(*(rounded(c, places[c]).alias(c) if c in places else F.col(c) for c in detections.columns))


def write_detections(detections: DataFrame, path: str) -> None:
    """Every detection, dropped ones too with their ``kept``, as JSON lines in the order of frames; a video's are in one folder."""
    detection_records(detections).repartition("video").sortWithinPartitions("video", "frame_index").write.mode("overwrite").partitionBy("video").json(path)


def write_scan(scan: DataFrame, path: str) -> None:
    """The scan by video; it serves any threshold later."""
    scan.repartition("video").sortWithinPartitions("video", "k").write.mode("overwrite").partitionBy("video").parquet(path)


def write_scans(path: str, videos: DataFrame, scan: DataFrame, cuts: DataFrame, at_cuts: DataFrame) -> None:
    """A scan and what a replay of it needs, as four tables in rows: no video is one row, as it is in ``stored_scans``."""
    tables = {"videos": videos.select("video", "duration"), "scan": scan.select("video", "k", "t", "n"), "cuts": cuts.select("video", "cut"), "at_cuts": at_cuts.select("video", "t", "n")}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stored_scans(videos: DataFrame, scan: DataFrame, cuts: DataFrame, at_cuts: DataFrame, length: float, step: float) -> DataFrame:
    """(video, value): each video's scan as the JSON text that ``sources.media.parse_scans`` reads; without cuts the arrays are empty."""
    windows = scan.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("windows"))
    marks = cuts.groupBy("video").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    counts = at_cuts.groupBy("video").agg(F.array_sort(F.collect_set(F.struct("t", "n"))).alias("cut_windows"))
    joined = videos.select("video", "duration").join(windows, "video", "left").join(marks, "video", "left").join(counts, "video", "left")
    whole = F.struct("duration", F.lit(float(step)).alias("frame_interval"), F.lit(float(length)).alias("window_seconds"), *(F.coalesce(c, F.array()).alias(c) for c in ("cuts", "windows", "cut_windows")))
    return joined.select("video", F.to_json(whole).alias("value"))


def track_records(tracks: DataFrame) -> DataFrame:
    """Tracks as they are reported: without pixels and vectors, times to 3 places, with num_detections."""
    kept = [c for c in tracks.columns if c not in ("pixels", "feature", "crops")]
    return tracks.select(*(rounded(c, 3).alias(c) if c in ("start_time", "end_time") else F.col(c) for c in kept))


def run_summaries(segments: DataFrame, videos: DataFrame, x: int, length: float) -> DataFrame:
    """(video, value): the summary of each video's run as JSON text, its segments in order of time."""
    shown = segments.withColumn("start", rounded("start", 3)).withColumn("end", rounded("end", 3))
    found = shown.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("start", "end", "character_count"))).alias("segments"))
    rows = videos.select("video", "duration").join(found, "video", "left")
    whole = F.struct("video", "duration", F.lit(float(length)).alias("window_seconds"), F.lit(x).cast("long").alias("x"), F.coalesce("segments", F.array()).alias("segments"))
    return rows.select("video", F.to_json(whole).alias("value"))
