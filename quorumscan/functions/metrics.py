"""Measures of predicted against true counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall(predicted: Column, truth: Column) -> Column:
    """min(p, g) / g; 1 where nothing is to be found."""
    return F.when(truth <= 0, F.lit(1.0)).otherwise(F.least(predicted, truth).cast("double") / truth)


def count_f1(predicted: Column, truth: Column) -> Column:
    """2 min(p, g) / (p + g); 1 where both are 0."""
    return F.when(predicted + truth == 0, F.lit(1.0)).otherwise(2.0 * F.least(predicted, truth) / (predicted + truth))


def count_ratio(predicted: Column, truth: Column) -> Column:
    """p / g; null where g is 0."""
    return predicted.cast("double") / F.nullif(truth, F.lit(0))


def shotwise_recall(predicted: str, truth: str) -> Column:
    """Recall summed over shots; null unless both arrays have as many shots."""
    hit = F.aggregate(F.zip_with(predicted, truth, lambda p, g: F.least(p, g)), F.lit(0), lambda s, x: s + x.cast("int"))
    total = F.aggregate(truth, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(F.size(predicted) == F.size(truth), F.when(total <= 0, F.lit(1.0)).otherwise(hit.cast("double") / total))
