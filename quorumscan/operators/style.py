"""What a video's style sets, as columns: videos of all styles go through one plan."""

from __future__ import annotations

from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumscan.config import EMBEDDER_THRESHOLDS, Config, StyleProfile
from quorumscan.functions.frontal import representative_score
from quorumscan.operators.evaluation import evidence_ratio, majority_style
from quorumscan.operators.gates import passes_frontal, passes_quality
from quorumscan.sources.media import probe_frames

#: What a profile sets, in its order.
SETTINGS = [f.name for f in fields(StyleProfile)]
KINDS = "detector string, embedder string, identity_threshold double, crop_margin double, min_face_height_ratio double, frontal_weight double"


def style_profiles(spark: SparkSession, config: Config) -> DataFrame:
    """(style, settings): the dimension table of the config's profiles."""
    rows = [(name, *(asdict(p)[s] for s in SETTINGS)) for name, p in config.style_profiles.items()]
    return spark.createDataFrame(rows, f"style string, {KINDS}")


def styled(videos: DataFrame, config: Config, style: str = "style") -> DataFrame:
    """``videos`` with one column for each setting of a profile, by the video's style.

    ``force_style`` is taken for every video, and without ``style_routing`` none is looked up.  An unknown or null style
    leaves the config's own settings.  A null threshold is that of the embedder.  The profiles are a handful of rows and are broadcast.
    """
    names = videos.drop(*SETTINGS)
    wanted = F.lit(config.force_style) if config.force_style else F.col(style)
    wanted = wanted if config.style_routing or config.force_style else F.lit(None).cast("string")
    profiles = style_profiles(videos.sparkSession, config).withColumnRenamed("style", "_style")
    found = names.withColumn("_wanted", wanted).join(F.broadcast(profiles.withColumn("_known", F.lit(True))), F.col("_wanted") == F.col("_style"), "left")
    kinds = dict(c.split() for c in KINDS.split(", "))
    own = [F.when(F.col("_known"), F.col(s)).otherwise(F.lit(getattr(config, s)).cast(kinds[s])).alias(s) for s in SETTINGS]
    out = found.select(*names.columns, *own)
    known = F.coalesce(*(F.when(F.col("embedder") == name, F.lit(x)) for name, x in EMBEDDER_THRESHOLDS.items()))
    return out.withColumn("identity_threshold", F.coalesce("identity_threshold", known))


def with_settings(rows: DataFrame, videos: DataFrame, *settings: str) -> DataFrame:
    """``rows`` (video, ...) with some settings of their videos; rows of videos that are not there go."""
    return rows.drop(*settings).join(videos.select("video", *settings), "video")


def styled_records(detections: DataFrame, videos: DataFrame, config: Config) -> DataFrame:
    """As ``gates.detection_records``, each video under its own least face height; ``videos`` comes from ``styled``."""
    ratio = "min_face_height_ratio"
    rows = with_settings(detections, videos, ratio)
    return rows.withColumn("kept", F.coalesce(passes_quality(config, ratio=F.col(ratio)) & passes_frontal(config), F.lit(False))).drop(ratio)


def styled_score(blur: str = "blur_var", confidence: str = "confidence", frontal: str = "frontal", weight: str = "frontal_weight") -> Column:
    """A sample's score under its video's frontal weight."""
    return representative_score(F.col(blur), F.col(confidence), F.col(frontal), F.col(weight))


def routed(votes: DataFrame, evidence: DataFrame, config: Config, key: str = "video") -> DataFrame:
    """(key, style, ratio, is_ambiguous) of each video with votes.

    ``votes`` has (key, is_3d), one row a probe; unless more than half are for it, the style is 2d.  Of the others, ``evidence`` (key, detector,
    confidence) has what both detectors find: the ratio of their summed confidences is infinite where the second finds nothing; under the
    config's bound the style is real, else 3d, and within the config's band it may well be the other.
    """
    kinds = majority_style(votes, key)
    first, second = (next(p.detector for name, p in config.style_profiles.items() if name == style) for style in ("2d", "real"))
    sums = evidence_ratio(evidence, key, "detector", "confidence", first, second, config.style_real_evidence_ratio, config.style_ambiguous_band)
    found = kinds.select(key, "style").join(sums.select(key, F.col("ratio").alias("_ratio")), key, "left")
    flat = F.col("style") == "2d"
    ratio = F.when(~flat, F.coalesce("_ratio", F.lit(float("inf"))))
    real = F.when(ratio < config.style_real_evidence_ratio, F.lit("real")).otherwise(F.lit("3d"))
    low, high = config.style_ambiguous_band
    return found.select(key, F.when(flat, F.lit("2d")).otherwise(real).alias("style"), ratio.alias("ratio"), F.coalesce(ratio.between(low, high), F.lit(False)).alias("is_ambiguous"))


def probes(videos: DataFrame, config: Config, total: str = "n_frames") -> DataFrame:
    """(video, frame_index) of the frames on which a video's style is judged, as many as the config says."""
    return videos.select("video", F.explode(probe_frames(F.col(total), config.style_probe_frames)).alias("frame_index"))
