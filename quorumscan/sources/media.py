"""Sources: sampled frames, cut logs, probes, annotated names, stored artefacts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumscan.config import EMBEDDER_THRESHOLDS
from quorumscan.functions import geometry
from quorumscan.functions.frontal import frontal_from_landmarks
from quorumscan.operators.overlap import carried

#: Fixed value: how a cut's time stands in the log of the cut filter.
CUT_TIME = r"lavfi\.scd\.time:\s*([\d.]+)"


def sampled_frames(frames: DataFrame, interval: float, limit_seconds: float | None = None, bin_frames: int = 100_000) -> DataFrame:
    """Raw frames (video, raw_index, fps) that a sampler at ``interval`` emits: video, sample_index, raw_index, time.

    The next frame is due at a multiple of the interval; a frame is emitted when its time plus 1e-9
    has reached it.  Intervals shorter than a frame emit every frame.  A frame is emitted if a multiple
    falls after the frame before and no later than itself, which needs no state; they are numbered
    within bins of ``bin_frames`` frames, on top of the number in all bins before.
    """
    time = F.col("raw_index") / F.col("fps")
    # A sampler that falls behind catches up one interval a frame: with intervals under a frame's time all are due.
    due = F.floor((time + F.lit(1e-9)) / F.lit(float(interval)))
    before = F.floor(((F.col("raw_index") - 1) / F.col("fps") + F.lit(1e-9)) / F.lit(float(interval)))
    hit = (F.col("raw_index") == 0) | (F.lit(float(interval)) * F.col("fps") <= 1) | (due > before)
    out = frames.withColumn("time", time).filter(hit)
    out = out if limit_seconds is None else out.filter(F.col("time") < float(limit_seconds))
    out = carried(out.withColumn("_bin", F.floor(F.col("raw_index") / bin_frames)), ["video"], "_bin", F.count(F.lit(1)), "_before", F.sum)
    at = F.row_number().over(Window.partitionBy("video", "_bin").orderBy("raw_index")) - 1 + F.coalesce("_before", F.lit(0))
    return out.select("video", at.cast("int").alias("sample_index"), "raw_index", "time")


def probe_frames(total: Column, n: int) -> Column:
    """The frame numbers of ``n`` probes spread evenly over ``total`` frames."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(total * (i + 0.5) / n).cast("int"))


def read_cut_log(spark: SparkSession, path: str) -> DataFrame:
    """(video, cut) from logs of the cut filter; the video is the log's file name."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("video"), "value")
    return lines.select("video", F.explode(F.regexp_extract_all("value", F.lit(CUT_TIME), F.lit(1))).alias("cut")).select("video", F.col("cut").cast("double").alias("cut"))


def valid_containers(probes: DataFrame) -> DataFrame:
    """Probes (video, codec, container, duration) with a problem: null for an H.264 stream in an MP4 of positive length."""
    problem = (
        F.when(F.col("codec").isNull(), "no video stream")
        .when(F.col("codec") != "h264", F.concat(F.lit("codec "), F.col("codec")))
        .when(~F.contains(F.col("container"), F.lit("mp4")), F.concat(F.lit("container "), F.col("container")))
        .when(~(F.coalesce("duration", F.lit(0.0)) > 0), "no duration")
    )
    return probes.withColumn("problem", problem)


def read_scans(spark: SparkSession, root: str) -> DataFrame:
    """Stored scans ``root/*/windows_scan.json`` as (video, k, t, n), the video being the folder's name."""
    raw = spark.read.option("multiLine", True).schema("windows array<struct<t:double,n:bigint>>").json(f"{root}/*/windows_scan.json")
    named = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1).alias("video"), F.posexplode("windows").alias("k", "w"))
    return named.select("video", F.col("k").cast("long").alias("k"), "w.t", "w.n")


#: A stored scan: what a replay for any threshold needs.
STORED_SCAN = "duration double, frame_interval double, window_seconds double, cuts array<double>, windows array<struct<t:double,n:bigint>>, cut_windows array<struct<t:double,n:bigint>>"


def parse_scans(rows: DataFrame, value: str = "value") -> DataFrame:
    """(video, duration, frame_interval, window_seconds, cuts, windows, cut_windows) of scans stored as JSON text."""
    return rows.select("video", F.from_json(value, STORED_SCAN).alias("s")).select("video", "s.*")


def read_stored_scans(spark: SparkSession, root: str) -> DataFrame:
    """Stored scans ``root/*/windows_scan.json``, one row a video, the video being the folder's name."""
    text = spark.read.text(f"{root}/*/windows_scan.json", wholetext=True)
    return parse_scans(text.select(F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1).alias("video"), "value"))


def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """(path, video, duration, window_seconds, x, segments) of the run summaries ``root/*/windows.json``, by path."""
    schema = "video string, duration double, window_seconds double, x bigint, segments array<struct<start:double,end:double,character_count:bigint>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(f"{root}/*/windows.json")
    return raw.withColumn("path", F.input_file_name()).orderBy("path")


def pairs_by_title(clips: DataFrame, films: DataFrame) -> DataFrame:
    """Clips joined to films of their title; clips without one are left out."""
    return clips.join(films, "title")


class Registry:
    """Named factories, one instance of each per process; a name is given once and must exist to be asked for."""

    def __init__(self) -> None:
        self.factories: dict[str, object] = {}
        self.instances: dict[str, object] = {}

    def register(self, name: str):
        def keep(factory):
            if name in self.factories:
                raise ValueError(f"{name} is registered already")
            self.factories[name] = factory
            return factory

        return keep

    def get(self, name: str):
        if name not in self.instances:
            self.instances[name] = self.factories[name]()
        return self.instances[name]


#: Functions from frames to boxes, for mapInPandas, and from vectors to differences.
detectors, embedders = Registry(), Registry()


@embedders.register("arcface")
def _arcface():
    from quorumscan.functions.geometry import cosine_difference

    return cosine_difference


def read_scans(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables videos, scan, cuts and at_cuts that ``sinks.write_scans`` has written."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("videos", "scan", "cuts", "at_cuts")}


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the picture files below a folder, whatever characters their names have; empty files are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


@dataclass(frozen=True)
class Hooks:
    """What a detector says of its boxes besides finding them, as column expressions that its entry may override.

    ``crop`` is the part of the frame that is compared later: by default the box grown by the margin and cut at the frame (null if
    nothing is left).  ``frontal`` is how frontal a face is, by default 1, which changes no order of samples.
    """

    crop: Callable[[Column], Column] = lambda margin: geometry.clamp_box(geometry.expand_box(geometry.box(), margin), F.col("frame_width"), F.col("frame_height"))
    frontal: Callable[[], Column] = lambda: F.lit(1.0)


#: Hooks by the detector's name; one that is not here has the neutral ones.
hooks: dict[str, Hooks] = {
    "real_face_scrfd": Hooks(frontal=lambda: frontal_from_landmarks("landmarks")),
}


def with_hooks(detections: DataFrame, margin: Column | float = 0.0, detector: str = "detector") -> DataFrame:
    """Detections of several detectors with crop and frontal, each by its own detector's hooks.

    ``margin`` is the growth of crops, a number or a column, as a style may set it.
    """
    grown = margin if isinstance(margin, Column) else F.lit(float(margin))
    neutral = Hooks()

    def chosen(of: Callable[[Hooks], Column]) -> Column:
        out = of(neutral)
        for name, own in sorted(hooks.items()):
            out = F.when(F.col(detector) == name, of(own)).otherwise(out)
        return out

    return detections.withColumn("crop", chosen(lambda h: h.crop(grown))).withColumn("frontal", chosen(lambda h: h.frontal()))


def default_threshold(embedder: str) -> float:
    """An embedder's own identity threshold; it must be known."""
    return EMBEDDER_THRESHOLDS[embedder]


def detect(frames: DataFrame, detector: str, schema: str) -> DataFrame:
    """Boxes that a registered detector finds; it is made once per Python worker and gets Arrow batches as pandas frames."""

    def run(batches):
        model = detectors.get(detector)
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)
