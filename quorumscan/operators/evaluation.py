"""How well predicted counts agree with annotated ones, and summaries of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumscan.functions.metrics import count_f1, count_ratio, recall

#: The annotations in a file name.
SHOT_FACES = r"人脸数期望[：:]\s*([\d+\s]+?)\s*[）)]"
CHARACTERS = r"跨镜头身份去重后期望[：:]\s*(\d+)"
TITLE = r"^(.+?)_(\d+)s"


def parse_truth(files: DataFrame, styles: dict[str, str], path: str = "path") -> DataFrame:
    """Annotated file names as rows: stem, title, source_offset, shot_faces, num_characters, style, num_shots, total_faces.

    ``styles`` is the style of each title, ``unknown`` for any other.  Names without annotations are left out; a name with only one of the two raises an error.
    """
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")
    rows = files.select(stem.alias("stem"))
    has_faces, has_characters = F.col("stem").rlike(SHOT_FACES), F.col("stem").rlike(CHARACTERS)
    rows = rows.filter(has_faces | has_characters)
    broken = F.raise_error(F.concat(F.lit("incomplete annotation: "), F.col("stem")))
    faces = F.transform(F.split(F.regexp_extract("stem", SHOT_FACES, 1), r"\+"), lambda x: F.trim(x).cast("int"))
    titled = F.col("stem").rlike(TITLE)
    style = F.coalesce(*(F.when(F.col("title") == title, F.lit(kind)) for title, kind in styles.items()), F.lit("unknown"))
    out = rows.select(
        "stem",
        F.when(titled, F.regexp_extract("stem", TITLE, 1)).otherwise(F.col("stem")).alias("title"),
        F.when(titled, F.regexp_extract("stem", TITLE, 2).cast("int")).otherwise(F.lit(0)).alias("source_offset"),
        F.when(has_faces & has_characters, faces).otherwise(broken.cast("array<int>")).alias("shot_faces"),
        F.regexp_extract("stem", CHARACTERS, 1).cast("int").alias("num_characters"),
    )
    total = F.aggregate("shot_faces", F.lit(0), lambda s, x: s + x)
    return out.withColumn("style", style).withColumn("num_shots", F.size("shot_faces")).withColumn("total_faces", total)


def scored(rows: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Rows with recall, f1, ratio of a predicted and a true count."""
    p, g = F.col(predicted), F.col(truth)
    return rows.withColumn("recall", recall(p, g)).withColumn("f1", count_f1(p, g)).withColumn("ratio", count_ratio(p, g))


def metric_rollup(rows: DataFrame, by: list[str], also: list[str], predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Macro and micro measures per ``by`` and per ``by`` with ``also`` (null in the rows of the former), in one pass.

    micro_recall is found counts over true counts; over_detected the rows that predict more than there is.
    """
    p, g = F.col(predicted), F.col(truth)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg(recall(p, g)).alias("macro_recall"),
        (F.sum(F.least(p, g)) / F.nullif(F.sum(g), F.lit(0))).alias("micro_recall"),
        F.count_if(p > g).alias("over_detected"),
        F.avg(count_f1(p, g)).alias("macro_f1"),
    ]
    sets = [[F.col(c) for c in by], [F.col(c) for c in (*by, *also)]]
    return rows.groupingSets(sets, *(F.col(c) for c in (*by, *also))).agg(*measures)


def best_threshold(rows: DataFrame, keys: list[str], threshold: str = "threshold", f1: str = "f1", prefer: str = "lowest") -> DataFrame:
    """The threshold of the best f1 per key; of equal ones the ``lowest`` or the ``highest``."""
    order = F.col(threshold).asc() if prefer == "lowest" else F.col(threshold).desc()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col(f1).desc(), order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def routing_accuracy(rows: DataFrame, predicted: str = "style", truth: str = "truth_style") -> DataFrame:
    """Right styles over rows that have a predicted one."""
    hit = F.count_if(F.col(predicted) == F.col(truth))
    return rows.filter(F.col(predicted).isNotNull()).agg(hit.alias("hits"), F.count(F.lit(1)).alias("n"), (hit / F.count(F.lit(1))).alias("accuracy"))


def upper_median(counts: str) -> Column:
    """The element at half the size of a sorted array; null of an empty one."""
    ordered = F.sort_array(counts)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs (name, duration, window_seconds, counts, ...) with segments, max_windows, median_count, max_count."""
    return runs.select(
        *runs.columns,
        F.size("counts").alias("segments"),
        F.floor(F.col("duration") / F.col("window_seconds")).cast("long").alias("max_windows"),
        F.coalesce(upper_median("counts"), F.lit(0)).alias("median_count"),
        F.coalesce(F.array_max("counts"), F.lit(0)).alias("max_count"),
    )


def grand_total(summary: DataFrame) -> DataFrame:
    """Segments, possible windows and their percentage over all runs."""
    return summary.agg(F.sum("segments").alias("segments"), F.sum("max_windows").alias("max_windows")).withColumn("percent", 100.0 * F.col("segments") / F.greatest(F.col("max_windows"), F.lit(1)))


def by_scope(rows: DataFrame, keys: list[str], scopes: list[str], measures: list[str]) -> DataFrame:
    """One row for each of ``rows`` and scope: keys, scope, measures; columns are named ``measure_scope``, one that is missing is null."""
    values = [F.struct(F.lit(s).alias("scope"), *((F.col(f"{m}_{s}") if f"{m}_{s}" in rows.columns else F.lit(None)).cast("double").alias(m) for m in measures)) for s in scopes]
    return rows.select(*keys, F.explode(F.array(*values)).alias("_v")).select(*keys, "_v.*")


def scope_totals(films: DataFrame, scopes: list[str], possible: str = "max_windows", counted: str = "segments") -> DataFrame:
    """(scope, segments, max_windows, percent) over all films, from columns ``segments_<scope>``; a film's possible windows count once a scope."""
    rows = by_scope(films, [possible], scopes, [counted]).groupBy("scope").agg(F.sum(counted).cast("long").alias(counted), F.sum(possible).cast("long").alias(possible))
    return rows.withColumn("percent", 100.0 * F.col(counted) / F.greatest(F.col(possible), F.lit(1)))


def film_shares(films: DataFrame, keys: list[str], scopes: list[str], possible: str = "max_windows", counted: str = "segments") -> DataFrame:
    """(keys, scope, segments, percent) of each film: how many of its possible windows a scope finds."""
    rows = by_scope(films, [*keys, possible], scopes, [counted])
    return rows.select(*keys, "scope", F.col(counted).cast("long").alias(counted), (100.0 * F.col(counted) / F.greatest(F.col(possible), F.lit(1))).alias("percent"))


def scope_macro(windows: DataFrame, scopes: list[str], truth: str = "truth", predicted: str = "pred") -> DataFrame:
    """(scope, n, macro_f1, macro_recall, mean_ratio) over windows, from counts ``pred_<scope>`` against ``truth``.

    A window whose count is null in a scope, as where there is no short clip of it, is left out of that scope; the ratio of one
    without a true character is null and left out of the mean.
    """
    rows = by_scope(windows, [truth], scopes, [predicted]).filter(F.col(predicted).isNotNull())
    measured = scored(rows, predicted, truth)
    return measured.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), F.avg("ratio").alias("mean_ratio"))


def majority_style(votes: DataFrame, key: str, vote: str = "is_3d") -> DataFrame:
    """Non-2D where votes for it are more than half; ties go to 2d."""
    out = votes.groupBy(key).agg(F.count_if(F.col(vote)).alias("n_3d"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("style", F.when(2 * F.col("n_3d") > F.col("total"), F.lit("3d")).otherwise(F.lit("2d")))


def evidence_ratio(detections: DataFrame, key: str, source: str, confidence: str, first: str, second: str, limit: float = 0.5, band: tuple[float, float] = (0.45, 0.80)) -> DataFrame:
    """Summed confidences of two detectors, their ratio (infinite over 0), is_real (under ``limit``), is_ambiguous (in the band)."""
    out = detections.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col(source) == first, F.col(confidence))), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col(source) == second, F.col(confidence))), F.lit(0.0)).alias("b"),
    )
    ratio = F.when(F.col("b") == 0, F.lit(float("inf"))).otherwise(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)))
    return out.withColumn("ratio", ratio).withColumn("is_real", F.col("ratio") < limit).withColumn("is_ambiguous", F.col("ratio").between(*band))


def sweep_table(rows: DataFrame, keys: list[str], row: str, column: str, values: list, cell: str) -> DataFrame:
    """A pivot of ``cell``: one line per keys and ``row``, one column per value; missing cells are null."""
    return rows.groupBy(*keys, row).pivot(column, values).agg(F.first(cell))


def sweep_range(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The least and the largest of each value per key, as min_ and max_ columns."""
    return rows.groupBy(*keys).agg(*(f(c).alias(f"{name}_{c}") for c in values for name, f in (("min", F.min), ("max", F.max))))


def gallery(tracks: DataFrame, key: str, cluster: str, order: str, clusters: int, per_cluster: int) -> DataFrame:
    """(key, cluster, place, pick) of a contact sheet: the largest clusters, of each ``per_cluster`` members spread evenly.

    Place i shows member min(n - 1, int(i * max(1, n / per_cluster))) by ``order``, so small clusters repeat.
    """
    ranked = tracks.withColumn("_at", F.row_number().over(Window.partitionBy(key, cluster).orderBy(order)) - 1)
    sizes = tracks.groupBy(key, cluster).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "_first"))
    top = sizes.withColumn("_r", place).filter(F.col("_r") <= clusters)
    picks = top.select(key, cluster, "n", F.explode(F.sequence(F.lit(0), F.lit(per_cluster - 1))).alias("place"))
    at = F.least(F.col("n") - 1, F.floor(F.col("place") * F.greatest(F.lit(1.0), F.col("n") / F.lit(float(per_cluster)))).cast("long"))
    return picks.withColumn("_at", at).join(ranked, [key, cluster, "_at"]).drop("_at", "n")
