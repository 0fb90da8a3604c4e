"""Accuracy matching of model groups: rates by difficulty bin, matched bin, weights, weighted contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.numbering import beside


def performance_by_bin(df: DataFrame, keys: list[str], bin_: str, correct: Column) -> DataFrame:
    return df.groupBy(*keys, bin_).agg(F.sum(correct.cast("bigint")).alias("correct_count"), F.count(F.lit(1)).alias("sample_count")).withColumn("rate", F.col("correct_count") / F.col("sample_count"))


def pooled_rate(perf: DataFrame, by: list[str]) -> DataFrame:
    return perf.groupBy(*by).agg((F.sum("correct_count") / F.sum("sample_count")).alias("rate"))


def matching_table(perf: DataFrame, model: str, bin_: str, target: float, tol: float) -> DataFrame:
    """Per bin: mean and spread of the models' pooled rates, distance to the target, whether the spread is within ``tol`` (and 1e-12 for rounding)."""
    by_model = pooled_rate(perf, [model, bin_])
    out = by_model.groupBy(bin_).agg(F.avg("rate").alias("grand_mean"), (F.max("rate") - F.min("rate")).alias("spread"), F.count(F.lit(1)).alias("n_models"))
    return out.withColumn("distance", F.abs(F.col("grand_mean") - target)).withColumn("eligible", F.col("spread") <= tol + 1e-12)


def matched_bin(table: DataFrame, bin_: str) -> DataFrame:
    """The eligible bin nearest to the target, the lowest on ties; null if there is none."""
    return table.agg(F.min(F.when(F.col("eligible"), F.struct(F.round("distance", 9).alias("d"), F.col(bin_).alias("b")))).alias("m")).select(F.col("m.b").alias("matched_bin"))


def stabilised_weights(perf: DataFrame, model: str, bin_: str, clip: float = 1e-4) -> DataFrame:
    """Weights of correct and wrong samples per model and bin: the bin's mean rate over the model's own."""
    own = pooled_rate(perf, [model, bin_]).withColumn("own", F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("rate"))))
    marginal = F.avg("own").over(Window.partitionBy(bin_))
    return own.withColumn("marginal", marginal).select(model, bin_, (F.col("marginal") / F.col("own")).alias("weight_correct"), ((1 - F.col("marginal")) / (1 - F.col("own"))).alias("weight_wrong"))


def weighted_contrast(df: DataFrame, by: list[str], correct: Column, value: str, weight: Column) -> DataFrame:
    """Weighted mean of correct less that of wrong rows; groups without both or without weight go."""
    mean = lambda c: F.sum(F.when(c, weight * F.col(value))) / F.sum(F.when(c, weight))
    total = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    out = df.groupBy(*by).agg(mean(correct).alias("correct_mean"), mean(~correct).alias("wrong_mean"), total(correct).alias("_a"), total(~correct).alias("_b"))
    return out.where("_a > 0 and _b > 0").withColumn("contrast", F.col("correct_mean") - F.col("wrong_mean")).drop("_a", "_b")


def group_zscore(df: DataFrame, by: list[str], value: str, floor: float = 1e-4) -> DataFrame:
    """``z``: distance to the group's mean in deviations (at least ``floor``). Rows meet one row per group; none is sorted or sent to its group."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.greatest(F.stddev_samp(value), F.lit(floor)).alias("_sd"))
    return beside(df, stats, by).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")
