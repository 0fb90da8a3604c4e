"""Resampling inference: sign flips, clusters, bootstrap, Holm, t intervals, Bayes factors.

Draws come from SHA-256 of (seed, draw, unit), so a result does not depend on
partitions, and any SQL engine with that hash gives the same. Tasks work out the
draws of a block of units and hand on their sums; no row for each unit and draw
is made.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.numbering import numbered_rows


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_sign(seed: int, draw: Column, unit: Column) -> Column:
    """+1 or -1 from the first hex digit of the hash."""
    return F.when(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), unit.cast("string")), 256), 1, 1) < "8", 1.0).otherwise(-1.0)


def sign_flip(df: DataFrame, by: list[str], value: str = "contrast", unit: str = "unit", n: int = 5000, seed: int = 7, two_sided: bool = False) -> DataFrame:
    """Mean and p = (1 + draws at least as large) / (n + 1); ties to 9 decimals count. Null values are left out."""
    stat = (lambda c: F.round(F.abs(c), 9)) if two_sided else (lambda c: F.round(c, 9))
    seen = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n_units"))
    sums = signed_sums(df.withColumn("_cell", F.lit(0)), by, "_cell", value, unit, n, seed)
    null = sums.join(seen, by).withColumn("null", F.col("total") / F.col("n_units"))
    return null.groupBy(*by, "mean", "n_units").agg(((1 + F.sum(F.when(stat(F.col("null")) >= stat(F.col("mean")), 1).otherwise(0))) / (n + 1)).alias("p_value"))


#: Most units of a group whose sign flips are counted one and all.
EXACT_UNITS = 40


def flips_at_least(x: np.ndarray, two_sided: bool = False) -> int:
    """How many of the 2^n sign flips of ``x`` have a sum at least as large as its own (``two_sided``: as far from 0).

    Each half's sums are listed and sorted; for every sum of one half the sums
    of the other that reach the rest are a range. Means that are equal to 9
    decimals count as ties.
    """
    def sums(part):
        out = np.zeros(1)
        for v in part:
            out = np.concatenate([out - v, out + v])
        return np.sort(out)

    a, b = sums(x[: len(x) // 2]), sums(x[len(x) // 2:])
    goal, slack = float(x.sum()), 0.5e-9 * len(x)
    goal = abs(goal) if two_sided else goal
    found = (len(b) - np.searchsorted(b, goal - slack - a, "left")).sum()
    if not two_sided:
        return int(found)
    if goal <= slack:
        return 2 ** len(x)
    return int(found + np.searchsorted(b, slack - goal - a, "right").sum())


def exact_sign_flip(df: DataFrame, by: list[str], value: str = "contrast", two_sided: bool = False) -> DataFrame:
    """Mean, ``n_units`` and the p of all 2^n sign flips: the share with a mean at least as large, its own among them.

    One row per unit is expected, and a group of more than ``EXACT_UNITS`` is
    an error (``sign_flip`` draws there). A task holds the values of one group
    and twice 2^(n / 2) sums. Null values are left out; a group without others has no row.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        if len(x) > EXACT_UNITS:
            raise ValueError(f"{len(x)} units are too many for all sign flips")
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in by}, "mean": [x.mean()], "n_units": [len(x)], "p_value": [flips_at_least(x, two_sided) / 2 ** len(x)]})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    return d.groupBy(*by).applyInPandas(one, f"{kinds}, mean double, n_units long, p_value double")


#: Units whose values a row of the bootstrap holds; slots and draws that are worked out together; the most rows for one such set of units.
HELD, SLOTS, DRAWS, SHARES = 1 << 20, 4096, 128, 256


def resampled_sums(df: DataFrame, by: list[str], value: str, unit: str, n: int, seed: int) -> DataFrame:
    """``by, size, draw, total``: the sums of ``n`` resamples; slot i of a draw takes the row (by order of ``unit``, from 0) that a hash of (seed, draw, i) names.

    The values of up to ``HELD`` units of a group lie in a row as an array. Its
    copies share the blocks of slots and draws among them: a task works out the
    picks of a block, looks up those that its units have and adds them up, so
    that only one number for each block and draw is shuffled.
    """
    d = numbered_rows(df.select(*by, unit, F.col(value).cast("double").alias("_x")), by, [unit], "_i", "_size")
    part = d.groupBy(*by, F.floor(F.col("_i") / HELD).alias("_from"), "_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda r: r["_x"]).alias("_xs"))
    blocks = F.ceil(F.col("_size") / SLOTS) * math.ceil(n / DRAWS)
    part = part.withColumn("_shares", F.least(F.lit(SHARES), blocks).cast("int")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    part = part.repartition(_tasks(df), *[F.col(k) for k in by], "_from", "_share")  # a number, as small rows with much work would be put together

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                x, size, low = np.array([np.nan if v is None else v for v in r["_xs"]], float), int(r["_size"]), int(r["_from"]) * HELD
                totals, counts = np.zeros(n), np.zeros(n)
                columns = math.ceil(n / DRAWS)
                for k in range(int(r["_share"]), math.ceil(size / SLOTS) * columns, int(r["_shares"])):
                    slots = [b"|%d" % i for i in range(k // columns * SLOTS, min(size, (k // columns + 1) * SLOTS))]
                    for draw in range(k % columns * DRAWS + 1, min(n, (k % columns + 1) * DRAWS) + 1):
                        head = b"%d|%d" % (seed, draw)
                        picks = np.frombuffer(b"".join([hashlib.sha256(head + s).digest()[:4] for s in slots]), ">u4").astype(np.int64) % size - low
                        taken = x[picks[(picks >= 0) & (picks < len(x))]] if len(x) < size else x[picks]
                        taken = taken[~np.isnan(taken)]
                        totals[draw - 1] += taken.sum()
                        counts[draw - 1] += len(taken)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({**{c: np.repeat(np.array([r[c]], dtype=object), len(at)) for c in by}, "draw": at + 1, "total": totals[at], "taken": counts[at].astype(int)})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    found = part.mapInPandas(run, f"{kinds}, draw int, total double, taken long")
    return found.groupBy(*by, "draw").agg(F.sum("total").alias("total"), F.sum("taken").alias("taken"))


def bootstrap_ci(df: DataFrame, by: list[str], value: str = "contrast", unit: str = "unit", n: int = 10_000, seed: int = 3) -> DataFrame:
    """Percentile interval (2.5, 97.5) of the means of ``n`` resamples (``resampled_sums``); null values that are drawn don't count."""
    means = resampled_sums(df, by, value, unit, n, seed).withColumn("_mean", F.col("total") / F.col("taken"))
    return means.groupBy(*by).agg(F.percentile("_mean", F.lit(0.025)).alias("ci_low"), F.percentile("_mean", F.lit(0.975)).alias("ci_high"))  # n numbers in each group


def t_statistic(df: DataFrame, by: list[str], value: str = "contrast") -> DataFrame:
    return df.groupBy(*by).agg((F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t_stat"), F.count(value).alias("n"))


def holm(df: DataFrame, family: list[str], p: str = "p_value", key: str | Column = "id") -> DataFrame:
    """Step-down adjusted p: running maximum of (m - rank + 1) p, at most 1; null and NaN p have none."""
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*family, fine).orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family, fine))
    d = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    run = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("p_holm", F.when(fine, F.least(F.lit(1.0), run))).drop("_step")


def runs_above(df: DataFrame, by: list[str], order: str, value: str, threshold: float | Column, inclusive: bool = False) -> DataFrame:
    """Maximal runs of rows above (``inclusive``: or at) ``threshold``: start, stop, length and mass."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_on", (F.col(value) >= threshold if inclusive else F.col(value) > threshold).cast("int"))
    d = d.withColumn("_new", F.when((F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0), 1).otherwise(0)).withColumn("run", F.sum("_new").over(w))
    return d.where("_on = 1").groupBy(*by, "run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("length"), F.sum(value).alias("mass"))


def signed_sums(df: DataFrame, by: list[str], cell: str, value: str, unit: str, n: int, seed: int, block: int = 512) -> DataFrame:
    """``total`` of value times ``hash_sign`` by group, cell and draw; tasks multiply the signs of some ``block`` units in as many draws with their rows."""
    d = df.where(F.col(value).isNotNull()).select(*by, cell, F.col(unit).cast("string").alias("_u"), F.col(value).cast("double").alias("_x"))
    blocks = max(1, math.ceil((d.agg(F.approx_count_distinct("_u")).first()[0] or 0) / block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, units = pd.factorize(pdf["_u"])
        c, cells = pd.factorize(pdf[cell])
        x = np.zeros((len(units), len(cells)))
        np.add.at(x, (u, c), pdf["_x"])
        first = int(pdf["_d"].iloc[0]) * block + 1
        some = np.arange(first, min(n, first + block - 1) + 1)
        names = [b"|" + name.encode() for name in units]
        heads = [b"%d|%d" % (seed, k) for k in some]
        first_byte = np.frombuffer(b"".join([hashlib.sha256(h + u).digest()[:1] for h in heads for u in names]), np.uint8).reshape(len(some), len(names))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, cell: np.repeat(np.asarray(cells), len(some)), "draw": np.tile(some, len(cells)), "total": (np.where(first_byte < 128, 1.0, -1.0) @ x).T.ravel()})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, cell])
    d = d.withColumn("_b", F.pmod(F.xxhash64("_u"), F.lit(blocks))).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(n / block) - 1))))
    d = d.repartition(_tasks(df), *[F.col(k) for k in by], "_b", "_d")
    parts = d.groupBy(*by, "_b", "_d").applyInPandas(run, f"{kinds}, draw int, total double")
    return parts.groupBy(*by, cell, "draw").agg(F.sum("total").alias("total"))


def cluster_sign_flip(df: DataFrame, by: list[str], time: str, threshold: float | None = None, value: str = "contrast", unit: str = "unit", n: int = 5000, seed: int = 5, p: float = 0.01) -> DataFrame:
    """Clusters of times with t at or above a threshold and their family-wise p against the largest mass of each draw.

    The threshold is the 1 - ``p`` quantile of t with the group's units less 1
    as degrees of freedom, unless one is given. A group of one unit has no
    clusters. Flips leave the squares as they are, so a draw needs sums alone.
    """

    @F.pandas_udf("double")
    def quantile(units: pd.Series) -> pd.Series:
        return units.map({k: t_quantile(1 - p, k - 1) for k in units.unique()})

    limits = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.countDistinct(unit).alias("_units")).where("_units > 1").withColumn("_limit", quantile("_units") if threshold is None else F.lit(float(threshold))).drop("_units")
    seen = runs_above(t_statistic(df, [*by, time], value).where("t_stat is not null").join(limits, by), by, time, "t_stat", F.col("_limit"), True)
    squares = df.groupBy(*by, time).agg(F.count(value).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_q")).where("_n > 1")
    flipped = signed_sums(df, by, time, value, unit, n, seed).join(squares, [*by, time]).join(limits, by)
    mean, size = F.col("total") / F.col("_n"), F.col("_n")
    flipped = flipped.withColumn("_v", (F.col("_q") - size * mean * mean) / (size - 1)).where("_v > 0").withColumn("t_stat", mean / F.sqrt(F.col("_v") / size))
    null = runs_above(flipped, [*by, "draw"], time, "t_stat", F.col("_limit"), True)
    top = null.groupBy(*by, "draw").agg(F.max("mass").alias("null"))
    hits = seen.join(top, by, "left").groupBy(*by, "run", "start", "stop", "length", "mass").agg(F.sum(F.when(F.round("null", 9) >= F.round("mass", 9), 1).otherwise(0)).alias("k"))
    return hits.withColumn("p_value", (1 + F.col("k")) / (n + 1)).drop("k")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d), 1 + up / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def t_quantile(p: float, df: float) -> float:
    """Student's t quantile by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    cdf = lambda t: 1 - 0.5 * _beta_tail(df / 2, 0.5, df / (df + t * t))
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_interval(df: DataFrame, by: list[str], value: str = "contrast", level: float = 0.9) -> DataFrame:
    """t interval of the mean; a point where n < 2 or the error is 0."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(0.5 + level / 2, k - 1) if k > 1 else 0.0 for k in n.unique()}
        return n.map(known)

    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem"))
    half = quantile("n") * F.col("sem")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def jzs_bayes_factor(n: int, mean: float, sd: float, scale: float = 0.5, points: int = 4000) -> float:
    """Directional Bayes factor of effect > 0 (half-Cauchy prior on the effect size) against no effect.

    The likelihood of t given effect d is the noncentral t density up to the
    factor common to both, as an integral over the scale s of the normal model.
    """
    if n < 2 or not sd or sd <= 0:
        return math.nan
    t, v = mean / (sd / math.sqrt(n)), n - 1
    u = (np.arange(points) + 0.5) / points
    d = scale * np.tan(np.pi * u / 2)  # midpoints of the prior's quantiles
    s = np.linspace(1e-6, 4, 2001)  # root of chi-square / v
    log_s = v * np.log(s) - v * s * s / 2  # density of s without its constant; one Jacobian s goes into the first term
    grid = lambda delta: np.log(np.trapezoid(np.exp(log_s[None, :] - 0.5 * (t * s[None, :] - delta[:, None]) ** 2), s, axis=1) + 1e-300)
    base = float(grid(np.zeros(1))[0])
    vals = np.concatenate([grid(part) for part in np.array_split(d * math.sqrt(n), 20)])
    return float(np.exp(vals - base).mean())


def bayes_factors(df: DataFrame, by: list[str], value: str = "contrast") -> DataFrame:
    """Bayes factor of each group from its n, mean and sd."""

    @F.pandas_udf("double")
    def factor(n: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([jzs_bayes_factor(int(a), b, c) for a, b, c in zip(n, m, s)])

    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("bayes_factor", factor("n", "mean", "sd"))
