"""Comparison of model profiles with a reference: distances, ranks, equivalence, hold-outs, pairs, dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.numbering import numbered_rows
from evenkeel.operators.resample import bootstrap_ci, holm, sign_flip, t_interval


def profile_distance(models: DataFrame, reference: DataFrame, by: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Root mean square distance, cosine, magnitude ratio and sign agreement over shared metrics; rank by distance, then key."""
    j = models.alias("m").join(reference.alias("r"), metric)
    a, b = F.col(f"m.{value}"), F.col(f"r.{value}")
    out = j.groupBy(*[F.col(f"m.{k}") for k in by]).agg(
        F.sqrt(F.avg((a - b) * (a - b))).alias("rms"), (F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"),
        F.sqrt(F.sum(a * a) / F.sum(b * b)).alias("magnitude"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign_agreement"))
    ranked = numbered_rows(out.withColumn("_r", F.round("rms", 9)), [], ["_r", *by], "_i")
    return ranked.withColumn("rank", (F.col("_i") + 1).cast("int")).drop("_r", "_i")


def leave_one_out(df: DataFrame, reference: DataFrame, held: str, by: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """``rms``, ``cosine`` (null without length) and ``sign_agreement`` for each group left out, against the mean of the others, every group with one weight."""
    part = reference.groupBy(held, metric).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = part.groupBy(metric).agg(F.collect_list(F.struct(F.col(held).alias("g"), "s", "n")).alias("_parts"))  # one for each group
    groups = reference.agg(F.collect_set(held).alias("_groups"))  # one row
    rest = every.join(F.broadcast(groups)).withColumn("held_out", F.explode("_groups"))
    total = lambda f: F.aggregate(F.filter("_parts", lambda p: p["g"] != F.col("held_out")), F.lit(0.0), lambda acc, p: acc + F.coalesce(f(p).cast("double"), F.lit(0.0)))
    rest = rest.select("held_out", metric, total(lambda p: p["n"]).alias("_n"), total(lambda p: p["s"]).alias("_s")).where("_n > 0").select("held_out", metric, F.try_divide("_s", "_n").alias("r"))
    j = df.join(rest, metric)
    return j.groupBy("held_out", *by).agg(F.sqrt(F.avg((F.col(value) - F.col("r")) ** 2)).alias("rms"), F.try_divide(F.sum(F.col(value) * F.col("r")), F.sqrt(F.sum(F.col(value) ** 2) * F.sum(F.col("r") ** 2))).alias("cosine"),
                                              F.avg((F.signum(value) == F.signum("r")).cast("double")).alias("sign_agreement"))


def equivalence(df: DataFrame, by: list[str], metric: str, value: str, scale: DataFrame, margin: float = 0.2) -> DataFrame:
    """Whether the 90 % t interval of each metric, in units of ``scale(metric, scale)``, lies within +- ``margin``; ``all_equivalent`` per group.

    The scale is that of the reference group, so that a noisy difference does not widen its own margin.
    """
    z = df.join(scale.select(F.col("metric").alias(metric), "scale"), metric).withColumn("_z", F.col(value) / F.col("scale"))
    out = t_interval(z, [*by, metric], "_z")
    out = out.withColumn("equivalent", F.coalesce((F.col("low") > -margin) & (F.col("high") < margin), F.lit(False)))
    return out.withColumn("all_equivalent", F.min(F.col("equivalent").cast("int")).over(Window.partitionBy(*by)) == 1)


def pair_differences(df: DataFrame, model: str, replicate: str, value: str) -> DataFrame:
    """``left_model, right_model, replicate, difference`` of each unordered pair of models over shared replicates."""
    a, b = df.alias("a"), df.alias("b")
    j = a.join(b, (F.col(f"a.{replicate}") == F.col(f"b.{replicate}")) & (F.col(f"a.{model}") < F.col(f"b.{model}")))
    return j.select(F.col(f"a.{model}").alias("left_model"), F.col(f"b.{model}").alias("right_model"), F.col(f"a.{replicate}").alias(replicate), (F.col(f"a.{value}") - F.col(f"b.{value}")).alias("difference"))


def pairwise(df: DataFrame, model: str, replicate: str, value: str) -> DataFrame:
    """Each unordered pair of models over shared replicates: mean and count of differences."""
    return pair_differences(df, model, replicate, value).groupBy("left_model", "right_model").agg(F.avg("difference").alias("difference"), F.count(F.lit(1)).alias("n"))


def paired_tests(df: DataFrame, by: list[str], value: str, unit: str, family: list[str] | None = None, two_sided: bool = False, flips: int = 10_000, resamples: int = 10_000) -> DataFrame:
    """Per group its ``mean``, ``n_units``, 95 % bootstrap interval and sign-flip ``p_value``; with ``family`` (some of ``by``) Holm's ``p_holm`` over the groups that share it.

    Null values are left out; a group without any other has no row. One row
    per group and unit is expected, as units are flipped and drawn whole.
    """
    d = df.where(F.col(value).isNotNull())
    out = sign_flip(d, by, value, unit, flips, two_sided=two_sided).join(bootstrap_ci(d, by, value, unit, resamples), by)
    return out if family is None else holm(out, family, key=F.struct(*by))


def paired_change(df: DataFrame, keys: list[str], stage: str, value: str, later: str, earlier: str) -> DataFrame:
    """``keys, change``: mean of the later stage less mean of the earlier one, for keys that have both."""
    return stage_gains(df, keys, stage, value, [("change", later, earlier)]).where("change is not null").select(*keys, "change")


def pareto_front(df: DataFrame, low: list[str], key: str, ranges: int = 256) -> DataFrame:
    """Rows that no other row beats: at most as large in all of ``low`` and smaller in one. Equal rows stay together, a row with a null in ``low`` beats none and stays.

    Two columns of any size: the least second value below each first value is
    a running minimum, over ``ranges`` of the first and then within each.
    More columns are compared pair by pair and suit summary tables, where
    ``key`` tells rows apart.
    """
    if len(low) != 2:
        a, b = df.alias("a"), df.alias("b")
        worse, some = F.col(f"a.{key}") != F.col(f"b.{key}"), F.lit(False)
        for c in low:
            worse, some = worse & (F.col(f"b.{c}") <= F.col(f"a.{c}")), some | (F.col(f"b.{c}") < F.col(f"a.{c}"))
        return a.join(b, worse & some, "left_anti")
    x, y = low
    per = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.min(y).alias("_least"))
    cuts = per.agg(F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(x))) if cuts else F.lit(0)
    per = per.withColumn("_range", at)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = per.groupBy("_range").agg(F.min("_least").alias("_top")).withColumn("_earlier", F.min("_top").over(before)).drop("_top")  # one row per range
    within = F.min("_least").over(Window.partitionBy("_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_within", within).join(F.broadcast(tops), "_range").select(x, "_least", F.least("_within", "_earlier").alias("_below"))
    beaten = (F.col("_below") <= F.col(y)) | (F.col("_least") < F.col(y))
    return df.join(per, x, "left").where(~F.coalesce(beaten, F.lit(False))).select(*df.columns)


def stage_gains(df: DataFrame, keys: list[str], stage: str, value: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Stage means side by side and named differences ``(name, later, earlier)``."""
    names = sorted({s for _, a, b in pairs for s in (a, b)})
    wide = df.groupBy(*keys).agg(*[F.avg(F.when(F.col(stage) == s, F.col(value))).alias(s) for s in names])
    for name, a, b in pairs:
        wide = wide.withColumn(name, F.col(a) - F.col(b))
    return wide


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd, median, quartile distance and mean / sd."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"))
    return out.select(*by, "n", "mean", "sd", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), (F.col("mean") / F.col("sd")).alias("effect"))


#: Name, whether runs that fail the gate go, and the least folds that a replicate must keep.
SCENARIOS = [("all_runs", False, 5), ("gated_folds", True, 3), ("complete_replicates", True, 5)]


def retention_tests(df: DataFrame, model: str, replicate: str, endpoints: dict[str, str], scenarios: list[tuple[str, bool, int]] = SCENARIOS, flips: int = 10_000, resamples: int = 10_000) -> DataFrame:
    """Every endpoint under every scenario: ``scenario, endpoint, model, mean, n_units, retained_folds, sd, effect`` with interval, p and Holm's p.

    ``df`` has one row for each run (model, replicate and fold); ``endpoints``
    names each endpoint's gate column. A replicate is the mean of the folds it
    keeps, and one with too few goes. Null gates are not passed, null values
    are no fold. Holm's p is over the models of one scenario and endpoint.
    """
    cell = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).cast("double").alias("value"), F.coalesce(F.col(g), F.lit(False)).alias("passed")) for e, g in endpoints.items()]))
    case = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(g).alias("gated"), F.lit(k).alias("least")) for n, g, k in scenarios]))
    d = df.select(model, replicate, cell.alias("c")).select(model, replicate, "c.*").where("value is not null")
    d = d.withColumn("s", case).select(model, replicate, "endpoint", "value", "passed", "s.*").where("passed or not gated")
    by = ["scenario", "endpoint", model]
    seeds = d.groupBy(*by, replicate, "least").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("folds")).where("folds >= least")
    tests = paired_tests(seeds, by, "value", replicate, ["scenario", "endpoint"], flips=flips, resamples=resamples)
    more = seeds.groupBy(*by).agg(F.sum("folds").alias("retained_folds"), F.stddev_samp("value").alias("sd"), (F.avg("value") / F.stddev_samp("value")).alias("effect"))
    return tests.join(more, by)


def retention_failures(df: DataFrame, model: str, gates: dict[str, str]) -> DataFrame:
    """``model, condition, failed_runs``: runs whose gate (a column for each condition) is not passed; conditions without any have no row."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(g).alias("passed")) for c, g in gates.items()]))
    d = df.select(model, cell.alias("c")).select(model, "c.*")
    return d.where("not coalesce(passed, false)").groupBy(model, "condition").agg(F.count(F.lit(1)).alias("failed_runs"))
