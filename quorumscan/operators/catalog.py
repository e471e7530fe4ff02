"""Status of tasks, latest children, names and totals of a library of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The stages of a task and their share of its time, in order.
STAGE_WEIGHTS = (("cuts", 0.10), ("scan", 0.75), ("identity", 0.10), ("select", 0.05))


def status_rollup(items: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Status of a parent: running while a child is queued or running; all cancelled; any failed; else done."""
    s = F.col(status)
    out = items.groupBy(key).agg(F.bool_or(s.isin("queued", "running")).alias("_open"), F.bool_and(s == "cancelled").alias("_off"), F.bool_or(s == "failed").alias("_bad"))
    state = F.when(F.col("_open"), "running").when(F.col("_off"), "cancelled").when(F.col("_bad"), "failed").otherwise("done")
    return out.select(key, state.alias("status"))


def first_error(items: DataFrame, key: str, order: str, status: str = "status", error: str = "error") -> DataFrame:
    """(key, error): the error of each parent's first failed child in ``order`` that has one."""
    return first_by_order(items.filter(F.col(status) == "failed"), [key], error, order)


def finished_items(items: DataFrame, status: str = "status", folder: str = "out_dir") -> DataFrame:
    """Items that are done and have a folder of results."""
    return items.filter((F.col(status) == "done") & (F.col(folder) != ""))


def latest(rows: DataFrame, order: str, n: int = 50, tie: str = "id") -> DataFrame:
    """The ``n`` latest rows; of equal times the largest ``tie`` first."""
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def items_with_assets(tasks: DataFrame, items: DataFrame, assets: DataFrame, task: str = "task_id", asset: str = "asset_id") -> DataFrame:
    """Items of the tasks with their asset's name and duration; ``?`` and 0 where it is gone."""
    found = tasks.select(task).join(items, task).join(assets.select(asset, "name", "duration"), asset, "left")
    return found.withColumn("name", F.coalesce("name", F.lit("?"))).withColumn("duration", F.coalesce("duration", F.lit(0.0)))


def characters_with_crop(segments: DataFrame, crops: DataFrame, ids: str = "character_ids", key: str = "video", character: str = "character_id") -> DataFrame:
    """Segments whose array ``ids`` keeps the characters that have a crop in their video."""
    kind = dict(segments.dtypes)[ids]
    shown = crops.select(key, F.col(character).alias("_id")).distinct()
    each = segments.select(key, ids).distinct().select(key, ids, F.posexplode(F.array_distinct(ids)).alias("_at", "_id"))
    inside = each.join(shown, [key, "_id"]).groupBy(key, ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_kept"))
    joined = segments.join(inside, [key, ids], "left")
    kept = F.coalesce("_kept", F.when(F.col(ids).isNotNull(), F.array().cast(kind)))
    return joined.select(*(kept.alias(c) if c == ids else F.col(c) for c in segments.columns))


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Parents with ``keep`` of their latest child by ``order`` (descending); nulls without one."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    top = children.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, *keep)
    return parents.join(top, key, "left")


def progress_percent(progress: DataFrame, stage: str = "stage", fraction: str = "fraction") -> DataFrame:
    """``progress`` with percent: finished stages' weights and the current one's by its fraction, clamped to [0, 1]."""
    done, branches = 0.0, F.lit(0.0)
    for name, weight in STAGE_WEIGHTS:
        part = F.lit(done) + F.lit(weight) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(fraction)))
        branches = F.when(F.col(stage) == name, part).otherwise(branches)
        done += weight
    return progress.withColumn("percent", F.bround(100 * branches, 0).cast("int"))


def distinct_names(rows: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """``rows`` with unique_name: later ones of a name get _2, _3 and so on."""
    at = F.row_number().over(Window.partitionBy(*key, name).orderBy(order))
    return rows.withColumn("unique_name", F.when(at == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), at.cast("string"))))


def queue_positions(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Queued rows with how many stand before them."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)


def library_totals(assets: DataFrame) -> DataFrame:
    """Number, seconds and bytes of all assets and the time their analysis takes, a quarter of the seconds."""
    return assets.agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("seconds"), F.sum("size").alias("bytes"), (F.sum("duration") / 4).alias("eta_seconds"))


def hit_share(items: DataFrame, length: float) -> DataFrame:
    """Segments of all items and the percentage of time that they cover, rounded half up."""
    total = F.sum("duration")
    percent = F.floor(F.sum("segments") * F.lit(100.0 * length) / F.nullif(total, F.lit(0.0)) + 0.5)
    return items.agg(F.sum("segments").alias("segments"), percent.cast("long").alias("percent"))


def apply_state(assets: DataFrame, states: DataFrame, key: str = "asset_id") -> DataFrame:
    """Assets with the values of pushed states where these are not null; states without an asset are skipped."""
    fresh = states.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in states.columns if c != key))
    joined = assets.join(fresh, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in fresh.columns else F.col(c) for c in assets.columns))


def reservoir(rows: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """A uniform sample of ``n`` rows: those with the smallest random keys.

    With ``key``, a column that tells rows apart, the keys are digests of it and the sample is the same in every run.
    """
    drawn = F.rand(seed) if key is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("_key", drawn).orderBy("_key").limit(n).drop("_key")


def first_by_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of each key's first row in ``order`` that has one."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def of_titles(films: DataFrame, titles: list[str] | None, title: str = "title") -> DataFrame:
    """Films whose title is one of ``titles``; all of them without any."""
    return films.filter(F.col(title).isin(*titles)) if titles else films


def in_order_of_creation(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by ``columns``, for a list that is shown; nulls come first, as in the service's database."""
    return rows.orderBy(*(F.col(c).asc_nulls_first() for c in columns))
