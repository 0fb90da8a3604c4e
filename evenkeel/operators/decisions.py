"""Declared mappings and decisions: columns, units and codes, rejection, roster with quality control, assembled features, stage geometry, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.levels import level_key
from evenkeel.operators.contracts import ContractError, one_to_one, require_unique


def map_columns(df: DataFrame, mapping: dict[str, str], by: list[str], order: list[str]) -> DataFrame:
    """The columns that ``mapping`` declares by name: ``__row_index__`` (place from 0 in ``order`` within ``by``), ``__literal__:x`` or a source column."""
    index = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1

    def one(name: str, source: str) -> Column:
        if source == "__row_index__":
            return index.alias(name)
        if source.startswith("__literal__:"):
            return F.lit(source.partition(":")[2]).alias(name)
        return F.col(source).alias(name)

    return df.select(*by, *[one(n, s) for n, s in mapping.items() if n not in by])


def lookup(code: Column, table: dict, other: Column | None = None) -> Column:
    """The label of a code; ``other`` (null) for codes that the table lacks. A null code has no label."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code]
    return found if other is None else F.coalesce(found, other)


def to_base_unit(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """``value`` in the base unit; an undeclared unit is an error when the row is read."""
    stop = F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(unit.cast("string"), F.lit("null")))).cast("double")
    return value * lookup(unit, {k: float(v) for k, v in factors.items()}, stop)


def pivot_first(df: DataFrame, keys: list[str], column: str, names: dict[str, str], value: str, order: str | None = None) -> DataFrame:
    """One row for each key with the first value that isn't null of every level in ``names`` (level to column): by ``order``, then (and without it) the least value, so that no shuffle decides."""
    rank = F.struct(*([F.col(order)] if order else []), F.col(value))
    pick = [F.min_by(F.col(value), F.when((F.col(column) == level) & F.col(value).isNotNull(), rank)).alias(name) for level, name in names.items()]
    return df.groupBy(*keys).agg(*pick)


def keep_valid(valid: DataFrame, keys: list[str], *tables: DataFrame) -> list[DataFrame]:
    """The rows of each table whose trial is among the valid ones."""
    return [t.join(valid.select(*keys), keys, "left_semi") for t in tables]


def feature_table(windowed: DataFrame, conventional: DataFrame, conditions: DataFrame, keys: list[str], outcome: str | None = None, metrics: DataFrame | None = None, time: str = "time_seconds") -> DataFrame:
    """Features of both kinds and conditions, one row for each trial; keys that repeat are an error.

    ``metrics``, the rows behind ``windowed``, must be unique by key and time. ``outcome`` names a column that comes again as ``outcome``.
    """
    if metrics is not None:
        require_unique(metrics, [*keys, time])
    out = one_to_one(one_to_one(conventional, windowed, keys), conditions, keys)
    return out if outcome is None else out.withColumn("outcome", F.col(outcome))


def qc_decisions(roster: DataFrame, qc: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, included, exclusion_stage, reason`` for each unit of the roster(include, reason) from qc(included, deviations).

    A unit that the roster excludes needs no quality control; any other without it is an error when the row is read.
    """
    j = roster.join(require_unique(qc, keys).withColumn("_there", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("missing quality control"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    source = ~F.coalesce(F.col("include"), F.lit(False))
    passed = F.when(source, False).when(F.col("_there").isNull(), missing).otherwise(F.coalesce("included", F.lit(False)))
    stage = F.when(source, "source_inventory").when(~F.col("_ok"), "preprocessing_qc")
    reason = F.when(source, F.coalesce("reason", F.lit(""))).when(~F.col("_ok"), F.concat_ws("; ", "deviations"))
    return j.withColumn("_ok", passed).select(*keys, F.col("_ok").alias("included"), stage.alias("exclusion_stage"), reason.alias("reason"))


def qc_counts(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Units acquired, included and excluded by stage, and whether a group has any left."""
    n = lambda c: F.count(F.when(c, 1))
    stage = F.col("exclusion_stage")
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("acquired"), n(F.col("included")).alias("included"), n(stage == "source_inventory").alias("at_source"), n(stage == "preprocessing_qc").alias("at_qc"), F.bool_or("included").alias("ready"))


def residual_improvement(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Mean of ``|before| - |after|`` by group, with the number of rows and the share that came nearer."""
    gain = F.abs(before) - F.abs(after)
    return df.groupBy(*by).agg(F.avg(gain).alias("improvement"), F.count(gain).alias("n"), F.avg((gain > 0).cast("double")).alias("nearer"))


def replication(df: DataFrame, contrast: str, discovery: str, scale: DataFrame, unit: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """Each contrast against the discovery one: distance in units of ``scale(metric, scale)``, share of metrics with its sign, units."""
    means = df.groupBy(contrast, metric).agg(F.avg(value).alias("_v"))
    centre = means.where(F.col(contrast) == discovery).select(metric, F.col("_v").alias("_c"))
    z = (F.col("_v") - F.col("_c")) / F.col("scale")
    out = means.join(centre, metric).join(scale, metric).groupBy(contrast).agg(F.sqrt(F.avg(z * z)).alias("distance"), F.avg((F.signum("_v") == F.signum("_c")).cast("double")).alias("same_direction"))
    return out.join(df.groupBy(contrast).agg(F.countDistinct(unit).alias("units")), contrast)


def held_out_reference(df: DataFrame, fold: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """``fold, metric, reference``: the mean of all rows outside the fold, from sums, so that no fold meets the rows of another."""
    part = df.groupBy(fold, metric).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = part.groupBy(metric).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    grid = part.select(fold).distinct().join(whole)  # folds by metrics, both few
    j = grid.join(part, [fold, metric], "left")
    left = F.col("all_n") - F.coalesce("n", F.lit(0))
    return j.select(fold, metric, F.when(left > 0, (F.col("all_s") - F.coalesce("s", F.lit(0.0))) / left).alias("reference"))


def stage_residuals(stages: DataFrame, reference: DataFrame, fold: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """Every stage value next to the reference of its fold, with ``residual``; rows without a fold meet all folds."""
    own = stages.join(reference, [fold, metric]) if fold in stages.columns else stages.join(reference, metric)
    return own.withColumn("residual", F.col(value) - F.col("reference"))


def stage_geometry(residuals: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distance, cosine and magnitude ratio of each profile to its held-out reference."""
    v, r = F.col(value), F.col("reference")
    return residuals.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms"), (F.sum(v * r) / F.sqrt(F.sum(v * v) * F.sum(r * r))).alias("cosine"), F.sqrt(F.sum(v * v) / F.sum(r * r)).alias("magnitude"))


def references(df: DataFrame, by: list[str], metric: str = "metric", value: str = "value", fold: str | None = None, floor: float = 1e-4) -> DataFrame:
    """``by, metric, center, scale``: mean and sample deviation (at least ``floor``) of the values.

    With ``fold`` a row for each fold, from all rows outside it: counts, means
    and squares of the folds are merged without it, so no row meets its own
    reference and none is copied. Null values are left out; a reference of
    fewer than two values has no scale, one of none no row.
    """
    stats = [F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("q")]
    if fold is None:
        part = df.groupBy(*by, metric).agg(*stats).where("n > 0")
        return part.select(*by, metric, F.col("m").alias("center"), F.when(F.col("n") > 1, F.greatest(F.sqrt(F.col("q") / (F.col("n") - 1)), F.lit(floor))).alias("scale"))
    part = df.groupBy(*by, metric, fold).agg(*stats)
    every = part.groupBy(*by, metric).agg(F.collect_list(F.struct(F.col(fold).alias("f"), "n", "m", "q")).alias("_parts"))  # one for each fold
    held = every.withColumn(fold, F.explode(F.transform("_parts", lambda p: p["f"]))).withColumn("_rest", F.filter("_parts", lambda p: ~p["f"].eqNullSafe(F.col(fold)) & (p["n"] > 0)))
    total = lambda f: F.aggregate("_rest", F.lit(0.0), lambda a, p: a + f(p))
    held = held.withColumn("_n", total(lambda p: p["n"])).where("_n > 0").withColumn("center", F.try_divide(total(lambda p: p["n"] * p["m"]), F.col("_n")))
    held = held.withColumn("_q", total(lambda p: p["q"] + p["n"] * (p["m"] - F.col("center")) * (p["m"] - F.col("center"))))
    return held.select(*by, metric, fold, "center", F.when(F.col("_n") > 1, F.greatest(F.sqrt(F.try_divide(F.col("_q"), F.col("_n") - 1)), F.lit(floor))).alias("scale"))


def external_transfer(vectors: DataFrame, reference: DataFrame, keys: list[str], contrast: str, metric: str = "metric", value: str = "value", fold: str | None = None) -> DataFrame:
    """``keys, contrast, rms, cosine, magnitude, n_metrics`` of every vector against every contrast's reference of another data set.

    The join is by metric, and with ``fold`` (one of ``keys``) by fold too: a
    vector that was made with a fold's rows meets the reference made without them.
    """
    on = [metric] + ([fold] if fold else [])
    j = vectors.join(reference, on)
    v, c = F.col(value), F.col("center")
    size = F.sqrt(F.sum(v * v) * F.sum(c * c))
    z = (v - c) / F.col("scale")
    return j.groupBy(*keys, contrast).agg(
        F.sqrt(F.avg(z * z)).alias("rms"), F.when(size > 0, F.sum(v * c) / size).alias("cosine"), (F.sqrt(F.sum(v * v)) / F.greatest(F.sqrt(F.sum(c * c)), F.lit(1e-12))).alias("magnitude"), F.count(F.lit(1)).alias("n_metrics"))


def stage_summary(geometry: DataFrame, model: str, replicate: str, stage: str) -> DataFrame:
    """Model and stage: mean and deviation of ``rms``, means of ``cosine`` and ``magnitude`` over replicates, each the mean of its folds; ``n_replicates``, ``n_folds``."""
    per = geometry.groupBy(model, stage, replicate).agg(*[F.avg(c).alias(c) for c in ("rms", "cosine", "magnitude")], F.count(F.lit(1)).alias("n"))
    return per.groupBy(model, stage).agg(
        F.avg("rms").alias("mean_rms"), F.stddev_samp("rms").alias("sd_rms"), F.avg("cosine").alias("mean_cosine"), F.avg("magnitude").alias("mean_magnitude"), F.count(F.lit(1)).alias("n_replicates"), F.sum("n").alias("n_folds"))


def harmonised(df: DataFrame, specs: DataFrame, dataset: str, level: str) -> DataFrame:
    """``df`` with ``outcome`` 1 or 0 by the data set's declared pair of levels; rows of other levels or undeclared data sets go.

    ``specs(dataset, positive, negative)`` is a declared list. A data set
    declared twice, with one level for both or without one, or one of whose
    two levels no row has, is an error. Levels are compared as keys (``level_key``).
    """
    s = specs.select(F.col("dataset").alias("_set"), level_key(F.col("positive")).alias("_pos"), level_key(F.col("negative")).alias("_neg"), (F.col("positive").isNull() | F.col("negative").isNull()).alias("_open"))
    bad = s.groupBy("_set").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("_pos") == F.col("_neg")) | F.col("_open")).alias("same")).where("n > 1 or same")
    found = sorted(str(r["_set"]) for r in bad.collect())
    if found:
        raise ContractError(f"ambiguous outcomes for {found}")
    key = level_key(F.col(level))
    d = df.join(s, df[dataset] == s["_set"]).withColumn("_key", key)
    d = d.withColumn("outcome", F.when(F.col("_key") == F.col("_pos"), 1).when(F.col("_key") == F.col("_neg"), 0))
    there = d.groupBy("_set").agg(F.max(F.col("outcome")).alias("high"), F.min(F.col("outcome")).alias("low"))
    absent = s.join(there, "_set", "left").where("coalesce(high, 0) = 0 or coalesce(low, 1) = 1")
    found = sorted(str(r["_set"]) for r in absent.select("_set").collect())
    if found:
        raise ContractError(f"a declared level has no row in {found}")
    return d.where("outcome is not null").select(*df.columns, "outcome")
