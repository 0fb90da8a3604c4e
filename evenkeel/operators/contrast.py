"""Contrasts between condition levels of a metric table (trial x time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.levels import level_key
from evenkeel.operators.contracts import ContractError


def in_window(df: DataFrame, start: float, stop: float, time: str = "t", required: bool = False) -> DataFrame:
    """Both ends count. With ``required`` a window that selects no row is an error."""
    found = df.where(F.col(time).between(start, stop))
    if required and found.isEmpty():
        raise ContractError(f"no row between {start} and {stop}")
    return found


def primary_contrast(df: DataFrame, positive: str, negative: str, window: tuple[float, float], metric: str = "value", group: tuple[str, ...] = ("dataset",), unit: str = "unit", trial: str = "trial", level: str = "level", time: str = "t") -> DataFrame:
    """Trial means in the window, then unit means by level, then positive - negative; units with one level only go."""
    keys = [*group, unit]
    rows = in_window(df, *window, time).withColumn("_level", level_key(F.col(level))).where(F.col("_level").isin(positive, negative))
    per_trial = rows.groupBy(*keys, "_level", trial).agg(F.avg(metric).alias("m"))
    mean = lambda x: F.avg(F.when(F.col("_level") == x, F.col("m")))
    wide = per_trial.groupBy(*keys).agg(mean(positive).alias("positive"), mean(negative).alias("negative")).dropna(subset=["positive", "negative"])
    return wide.withColumn("contrast", F.col("positive") - F.col("negative"))


def timecourse(df: DataFrame, positive: str, negative: str, bins: str, metric: str = "value", group: tuple[str, ...] = ("dataset",), unit: str = "unit", level: str = "level") -> DataFrame:
    """Contrast for each unit and time bin."""
    rows = df.withColumn("_level", level_key(F.col(level)))
    mean = lambda x: F.avg(F.when(F.col("_level") == x, F.col(metric)))
    return rows.groupBy(*group, unit, bins).agg((mean(positive) - mean(negative)).alias("contrast")).dropna(subset=["contrast"])


def mean_band(df: DataFrame, by: list[str], value: str = "contrast", z: float = 1.96) -> DataFrame:
    """Mean, standard error, count and the band of ``z`` errors."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))
    return out.withColumn("low", F.col("mean") - z * F.col("sem")).withColumn("high", F.col("mean") + z * F.col("sem"))


def long_contrasts(df: DataFrame, positive: str, negative: str, metrics: list[str], keys: list[str], level: str = "level") -> DataFrame:
    """Contrast of several metrics, one row per key and metric."""
    mean = lambda x, m: F.avg(F.when(level_key(F.col(level)) == x, F.col(m)))
    wide = df.groupBy(*keys).agg(*[(mean(positive, m) - mean(negative, m)).alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, "metric", "contrast").where("contrast is not null")


def spec_contrasts(df: DataFrame, specs: DataFrame, keys: list[str], metric: str = "value", time: str = "t", level: str = "level") -> DataFrame:
    """All contrasts of ``specs(contrast_id, dataset, positive, negative, start, stop)`` in one scan: a row serves every spec that wants it."""
    hit = (F.col("s.dataset") == F.col("d.dataset")) & F.col(f"d.{time}").between(F.col("s.start"), F.col("s.stop"))
    rows = df.withColumn("_level", level_key(F.col(level))).alias("d").join(specs.alias("s"), hit)  # by data set; Spark broadcasts the specs where it finds them small
    mean = lambda side: F.avg(F.when(F.col("d._level") == F.col(f"s.{side}"), F.col(f"d.{metric}")))
    return rows.groupBy("s.contrast_id", *[f"d.{k}" for k in keys]).agg((mean("positive") - mean("negative")).alias("contrast")).where("contrast is not null")
