"""Trial features, windows over ordered rows, covariate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed_features(df: DataFrame, keys: list[str], metrics: list[str], windows: dict[str, tuple[float, float]], time: str = "t") -> DataFrame:
    """``metric__window`` means per key, both ends of a window included."""
    cols = [F.avg(F.when(F.col(time).between(a, b), F.col(m))).alias(f"{m}__{name}") for m in metrics for name, (a, b) in windows.items()]
    return df.groupBy(*keys).agg(*cols)


def sensor_features(df: DataFrame, trial: list[str], channel: str, value: str) -> DataFrame:
    """Mean, spatial sd (ddof 0) of channel means, mean power per trial."""
    per = df.groupBy(*trial, channel).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"), F.count(value).alias("n"))
    return per.groupBy(*trial).agg((F.sum("s") / F.sum("n")).alias("erp_mean"), F.stddev_pop("m").alias("gfp"), (F.sum("s2") / F.sum("n")).alias("power"))


def dummies(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Drop-first 0/1 columns ``column__level`` of sorted levels."""
    return df.select("*", *[(F.col(column) == v).cast("double").alias(f"{column}__{v}") for v in sorted(levels)[1:]])


#: Most levels of a column that is made into dummies.
MOST_LEVELS = 1000


def coded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers: one whose values all read as numbers becomes ``double``; any other gives drop-first dummies of its sorted levels, as ``name__level``.

    Levels are found in the data, in one pass over all columns; null, NaN and
    blank values are no level, and no number. More than ``MOST_LEVELS`` levels
    are an error: such a column is no condition.
    """
    text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    level = {c: F.when((t != "") & (F.lower(t) != "nan"), t) for c, t in text.items()}
    number = {c: t.try_cast("double") for c, t in level.items()}
    seen = df.agg(*[F.bool_and(F.when(level[c].isNotNull(), number[c].isNotNull())).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    out = {c: number[c] for i, c in enumerate(columns) if seen[i] in (True, None)}
    rest = [c for c in columns if c not in out]
    found = {}
    if rest:
        long = df.select(F.posexplode(F.array(*[level[c] for c in rest])).alias("c", "v")).where("v is not null").distinct()
        got = long.limit(MOST_LEVELS * len(rest) + 1).collect()
        for r in got:
            found.setdefault(rest[r["c"]], []).append(r["v"])
        large = [c for c in rest if len(found.get(c, [])) > MOST_LEVELS]
        if large or len(got) > MOST_LEVELS * len(rest):
            raise ValueError(f"more than {MOST_LEVELS} levels in {large or rest}")
    made = {f"{c}__{v}": F.when(level[c].isNotNull(), (level[c] == v).cast("double")) for c in rest for v in sorted(found[c])[1:]}
    return df.select(*[c for c in df.columns if c not in columns], *[x.alias(c) for c, x in out.items()], *[x.alias(c) for c, x in made.items()])


def fit_baseline(df: DataFrame, by: list[str], metrics: list[str], mask: Column) -> DataFrame:
    """``by, metric, center, scale``: mean and sample deviation of each metric over masked rows, nulls and NaN left out. No variance, or fewer than two values, is an error when the row is read."""
    clean = [F.when(mask & ~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics]
    long = df.select(*by, *clean).unpivot(by, metrics, "metric", "_v")
    g = long.groupBy(*by, "metric").agg(F.avg("_v").alias("center"), F.stddev_samp("_v").alias("_s"))
    stop = F.raise_error(F.concat_ws(" ", F.lit("no baseline variance of"), "metric", *[F.col(k).cast("string") for k in by])).cast("double")
    return g.select(*by, "metric", "center", F.when(F.coalesce(F.col("_s"), F.lit(0.0)) > 0, F.col("_s")).otherwise(stop).alias("scale"))


def composite_index(df: DataFrame, baseline: DataFrame, by: list[str], weights: dict[str, float], out: str = "index") -> DataFrame:
    """``z_metric`` for every weighted metric by its fitted baseline, and their weighted sum; weights are at least 0 and made to sum to 1."""
    total = sum(weights.values())
    if not weights or min(weights.values()) < 0 or not 0 < total < float("inf"):
        raise ValueError("weights must be at least 0 and sum to more")
    pick = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"_{c}_{m}") for m in weights for c in ("center", "scale")]
    wide = baseline.groupBy(*by).agg(*pick)
    d = df.join(wide, by)
    z = {f"z_{m}": (F.col(m) - F.col(f"_center_{m}")) / F.col(f"_scale_{m}") for m in weights}
    return d.withColumns(z).withColumn(out, sum(F.lit(w / total) * F.col(f"z_{m}") for m, w in weights.items())).drop(*[f"_{c}_{m}" for m in weights for c in ("center", "scale")])


def impulse(df: DataFrame, by: list[str], time: str, onset: Column) -> DataFrame:
    """1 at the row nearest to the onset (the earlier on ties), else 0; no onset, no impulse."""
    w = Window.partitionBy(*by).orderBy(F.abs(F.col(time) - onset).asc_nulls_last(), time)
    return df.withColumn("impulse", F.when(onset.isNotNull() & (F.row_number().over(w) == 1), 1.0).otherwise(0.0))


def time_basis(df: DataFrame, time: str, low: float, high: float, n: int) -> DataFrame:
    """Gaussian columns at ``n`` equal centres, 1.5 spacings wide."""
    step = (high - low) / max(1, n - 1)
    width = 1.5 * step or 1.0
    return df.select("*", *[F.exp(-0.5 * ((F.col(time) - (low + i * step)) / width) ** 2).alias(f"basis_{i}") for i in range(n)])


def trajectories(df: DataFrame, by: list[str], order: str, value: str, h: int) -> DataFrame:
    """Each start with the ``h`` rows that follow; complete windows only."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, h)
    return df.withColumn("path", F.collect_list(value).over(w)).where(F.size("path") == h + 1)


def lagged(df: DataFrame, by: list[str], order: str, value: str, lag: int) -> DataFrame:
    """Difference to the row ``lag`` later; null at the tail."""
    return df.withColumn("change", F.lead(value, lag).over(Window.partitionBy(*by).orderBy(order)) - F.col(value))


def one_step_error(df: DataFrame, by: list[str], order: str | list[str], value: str, prediction: Column, within: list[str] | None = None) -> DataFrame:
    """Mean squared errors of predictions and of persistence, R squared and relative gain by ``by``; the next value is that of the next row ``within`` (``by`` unless given)."""
    nxt = F.lead(value).over(Window.partitionBy(*(within or by)).orderBy(*([order] if isinstance(order, str) else order)))
    d = df.withColumn("_next", nxt).withColumn("_pred", prediction).where("_next is not null")
    out = d.groupBy(*by).agg(F.avg((F.col("_next") - F.col("_pred")) ** 2).alias("model_mse"), F.avg((F.col("_next") - F.col(value)) ** 2).alias("persistence_mse"), F.var_pop("_next").alias("_v"))
    return out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("model_mse") / F.col("_v"))).withColumn("gain", F.when(F.col("persistence_mse") > 0, 1 - F.col("model_mse") / F.col("persistence_mse"))).drop("_v")


def masked_accuracy(df: DataFrame, by: list[str], head: str, mask: Column, hit: Column) -> DataFrame:
    """Accuracy per head over masked rows, then the mean over heads with any."""
    return df.where(mask).groupBy(*by, head).agg(F.avg(hit.cast("double")).alias("a")).groupBy(*by).agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("n_heads"))


def accuracy_drop(df: DataFrame, by: list[str], head: str, mask: Column, label: Column, baseline: Column, ablated: Column, repeat: str | None = None) -> DataFrame:
    """``baseline, ablated, drop`` of masked accuracies, and with ``repeat`` a row for each repeat of the ablation.

    Both predictions stand in one row, so one pass serves both; a head counts
    once whatever its rows, and one without masked rows does not.
    """
    keys = [*by, *([repeat] if repeat else [])]
    hit = lambda p: F.avg(F.coalesce(p == label, F.lit(False)).cast("double"))
    per = df.where(mask).groupBy(*keys, head).agg(hit(baseline).alias("b"), hit(ablated).alias("a"))
    return per.groupBy(*keys).agg(F.avg("b").alias("baseline"), F.avg("a").alias("ablated"), F.count(F.lit(1)).alias("n_heads")).withColumn("drop", F.col("baseline") - F.col("ablated"))


def exploded(df: DataFrame, keys: list[str], arrays: list[str], index: str = "t") -> DataFrame:
    """Rows of ``keys, index`` and one value of each array: a tensor's time axis as rows. Arrays of one row that differ in length are an error; a null or empty one gives no row."""
    size = F.size(arrays[0])
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.coalesce(F.size(a), F.lit(-1)) == size)
    zipped = F.when(same, F.arrays_zip(*arrays))
    d = df.withColumn("_ok", F.when(same | F.col(arrays[0]).isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("arrays of one row differ in length")).cast("boolean"))).where("_ok")
    return d.select(*keys, F.posexplode(zipped).alias(index, "_z")).select(*keys, index, *[F.col("_z")[a].alias(a) for a in arrays])


def gathered(df: DataFrame, keys: list[str], values: list[str], index: str = "t") -> DataFrame:
    """The inverse of ``exploded``: one row for each key with its values as arrays in order of ``index``. A group is one row's worth of values."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("_i"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])))
    g = df.groupBy(*keys).agg(rows.alias("_rows"))
    return g.select(*keys, *[F.col("_rows")[f"_v{i}"].alias(v) for i, v in enumerate(values)])
