"""From raw logs and samples to trials: trigger windows, epochs, nearest samples, artefacts, references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.contracts import ContractError
from evenkeel.operators.numbering import beside
from evenkeel.operators.quantiles import exact_quantiles


def trigger_windows(df: DataFrame, by: list[str], order: str, opening: Column, outcome: Column, code: Column) -> DataFrame:
    """Each opening marker starts a window until the next; ``first_code`` is that of the first outcome row inside. Windows without one go."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("window", F.sum(opening.cast("int")).over(w)).withColumn("_out", outcome)
    out = d.where("window > 0").groupBy(*by, "window").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n_rows"), F.min(F.when(F.col("_out"), F.struct(F.col(order).alias("at"), code.alias("code")))).alias("o"))
    return out.where("o is not null").select(*by, "window", "start", "n_rows", F.col("o.at").alias("outcome_at"), F.col("o.code").alias("first_code"))


def window_decisions(df: DataFrame, by: list[str], order: str, opening: Column, outcome: Column, code: Column, invalid: Column | None = None, interruption: Column | None = None) -> DataFrame:
    """Every trigger window with its ``decision``, so that trials and exclusions come from one pass.

    ``kept`` has an outcome inside; ``invalid`` has none but an ``invalid``
    row; ``interrupted`` has neither but an ``interruption`` (the opening row
    counts too); any other is ``unresolved``. Rows before the first opening
    belong to no window; null conditions don't hold.
    """
    w = Window.partitionBy(*by).orderBy(order)
    holds = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    d = df.withColumn("window", F.sum(holds(opening).cast("int")).over(w)).where("window > 0")
    first = F.min(F.when(holds(outcome), F.struct(F.col(order).alias("at"), code.alias("code"))))
    g = d.groupBy(*by, "window").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n_rows"), first.alias("o"), F.max(holds(invalid)).alias("bad"), F.max(holds(interruption)).alias("cut"))
    decision = F.when(F.col("o").isNotNull(), "kept").when(F.col("bad"), "invalid").when(F.col("cut"), "interrupted").otherwise("unresolved")
    return g.select(*by, "window", "start", "n_rows", F.col("o.at").alias("outcome_at"), F.col("o.code").alias("first_code"), decision.alias("decision"))


def require_resolved(decisions: DataFrame) -> DataFrame:
    """The windows whose decision is ``kept``; one without any reason to be left out is an error."""
    if not decisions.where("decision = 'unresolved'").isEmpty():
        raise ContractError("windows without outcome, invalid code or interruption")
    return decisions.where("decision = 'kept'").drop("decision")


def excluded_windows(decisions: DataFrame) -> DataFrame:
    """The side table of interrupted windows, with ``reason``."""
    return decisions.where("decision = 'interrupted'").drop("decision", "outcome_at", "first_code").withColumn("reason", F.lit("recording discontinuity before the outcome"))


def epochs(events: DataFrame, samples: DataFrame, by: list[str], onset: str, time: str, before: float, after: float) -> DataFrame:
    """Samples within [onset - before, onset + after] of each event, by buckets of the window's width."""
    width = before + after
    ev = events.withColumn("_b", F.explode(F.sequence(F.floor((F.col(onset) - before) / width), F.floor((F.col(onset) + after) / width))))
    sm = samples.withColumn("_b", F.floor(F.col(time) / width))
    j = ev.join(sm, [*by, "_b"]).where(F.col(time).between(F.col(onset) - before, F.col(onset) + after))
    return j.withColumn("relative", F.col(time) - F.col(onset)).drop("_b")


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, other: str, keep: str) -> DataFrame:
    """For each left row the ``keep`` of the right row nearest in time (the earlier on ties): last before and first after, no product of the sides."""
    extra = [c for c in left.columns if c not in by and c != time]
    a = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), *extra, F.lit(None).cast(right.schema[keep].dataType).alias("_k"), F.lit(None).cast(right.schema[other].dataType).alias("_o"))
    b = right.select(*by, F.col(other).alias("_t"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra], F.col(keep).alias("_k"), F.col(other).alias("_o"))
    pair = F.when(F.col("_side") == 0, F.struct("_o", "_k"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_k")
    u = a.unionByName(b)
    u = u.withColumn("_prev", F.last(pair, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.first(pair, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = lambda x: F.abs(F.col(f"{x}._o") - F.col("_t"))
    pick = F.when(F.col("_next").isNull() | (gap("_prev") <= gap("_next")), F.col("_prev")).otherwise(F.col("_next"))
    return u.where("_side = 1").withColumn("_p", pick).select(*by, F.col("_t").alias(time), *extra, F.col("_p._k").alias(keep), F.abs(F.col("_p._o") - F.col("_t")).alias("gap"))


def nearest_grid(df: DataFrame, by: list[str], time: str, requested: list[float]) -> DataFrame:
    """``by, step, requested`` and the nearest ``time`` of each requested one (the earlier on ties); two requests that get one time are an error when the row is read.

    The grid is a short declared list: one pass keeps the nearest row of each entry.
    """
    near = [F.min(F.struct(F.abs(F.col(time) - r).alias("d"), F.col(time).alias("t"))).alias(f"_{i}") for i, r in enumerate(requested)]
    g = df.where(F.col(time).isNotNull()).groupBy(*by).agg(*near)
    picks = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(r)).alias("requested"), F.col(f"_{i}.t").alias(time)) for i, r in enumerate(requested)])
    g = g.withColumn("_p", picks)
    distinct = F.size(F.array_distinct(F.transform("_p", lambda p: p[time]))) == len(requested)
    stop = F.raise_error(F.concat_ws(" ", F.lit("no distinct times for the grid"), *[F.col(k).cast("string") for k in by])).cast("boolean")
    return g.where(F.when(distinct, F.lit(True)).otherwise(stop)).select(*by, F.explode("_p").alias("_p")).select(*by, "_p.*")


def nearest_in_order(y: np.ndarray, goal: np.ndarray) -> np.ndarray | None:
    """Places in the sorted ``y`` nearest to the sorted goals (the earlier on ties), each behind the one before; None where one finds no place."""
    at = np.searchsorted(y, goal)
    low, high = np.clip(at - 1, 0, len(y) - 1), np.clip(at, 0, len(y) - 1)
    pick = np.where(np.abs(y[low] - goal) <= np.abs(y[high] - goal), low, high)
    if (np.diff(pick) > 0).all():
        return pick
    last = -1
    for i, g in enumerate(goal):  # two goals want one place
        near = [k for k in (at[i] - 1, at[i]) if last < k < len(y)]
        if not near:
            return None
        last = pick[i] = min(near, key=lambda k: abs(y[k] - g))
    return pick


#: Goals whose distances bound a shift's cost from below, and shifts that are bounded at a time.
ANCHORS, SHIFTS = 24, 4096


def best_shift(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Of the shifts that put ``x[0]`` on a ``y`` the match with the least (greatest, mean) distance, the first of equal ones.

    No match is nearer than the nearest ``y``, so the distances of a few spread
    ``x`` bound each shift's cost; shifts are tried in order of that bound, and
    none whose bound exceeds the best cost so far is tried.
    """
    spread = x[np.unique(np.linspace(0, len(x) - 1, ANCHORS).astype(int))]
    bounds = []
    for low in range(0, len(y), SHIFTS):
        goal = (y[low:low + SHIFTS] - x[0])[:, None] + spread[None, :]
        at = np.searchsorted(y, goal)
        near = np.minimum(np.abs(y[np.clip(at - 1, 0, len(y) - 1)] - goal), np.abs(y[np.clip(at, 0, len(y) - 1)] - goal))
        bounds.append(near.max(1))
    bound = np.concatenate(bounds)
    best = None
    for k in np.argsort(bound, kind="stable"):
        if best is not None and bound[k] > best[0][0]:
            break
        goal = x + (y[k] - x[0])
        pick = nearest_in_order(y, goal)
        if pick is not None:
            gap = np.abs(y[pick] - goal)
            cost = (float(gap.max()), float(gap.mean()), int(k))
            if best is None or cost < best[0]:
                best = (cost, pick)
    return None if best is None else best[1]


def align_clocks(behaviour: DataFrame, triggers: DataFrame, by: str, time: str = "t", slope: tuple[float, float] = (0.999, 1.001), residual: float = 0.01) -> DataFrame:
    """Order-preserving match of two clocks per recording: best offset (``best_shift``), nearest triggers, affine fit, a second match along the
    fitted line and its fit, limits on slope and residual.

    Columns: the key, ``t`` (behaviour), ``trigger``, ``slope``, ``intercept``, ``max_residual``, ``ok``. A recording without a match has no row;
    one whose second match finds no order keeps the first and is not ok. One task holds one recording.
    """

    def match(key, b: pa.Table, g: pa.Table) -> pa.Table:
        x, y = (np.sort(t.column(time).drop_null().to_numpy()).astype(float) for t in (b, g))
        x, y = x[~np.isnan(x)], y[~np.isnan(y)]
        first = best_shift(x, y) if len(x) and len(y) >= len(x) else None
        n = 0 if first is None else len(x)
        z, a, c, worst, ok = np.zeros(n), 0.0, 0.0, 0.0, False
        if n:
            line = lambda z: np.polyfit(x, z, 1) if n > 1 else (1.0, z[0] - x[0])
            a, c = line(y[first])
            again = nearest_in_order(y, a * x + c)
            z = y[first if again is None else again]
            a, c = line(z)
            worst = float(np.abs(a * x + c - z).max())
            ok = again is not None and bool(slope[0] <= a <= slope[1] and worst <= residual)
        same = lambda v, t: pa.array([v] * n, t)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, b.schema.field(by).type if b.num_rows else g.schema.field(by).type), pa.array(x[:n]), pa.array(z), same(float(a), pa.float64()), same(float(c), pa.float64()), same(worst, pa.float64()), same(ok, pa.bool_())],
                                    [by, "t", "trigger", "slope", "intercept", "max_residual", "ok"])

    kind = behaviour.schema[by].dataType.simpleString()
    few = lambda d: d.select(by, F.col(time).cast("double").alias(time)).groupBy(by)
    return few(behaviour).cogroup(few(triggers)).applyInArrow(match, f"{by} {kind}, t double, trigger double, slope double, intercept double, max_residual double, ok boolean")


def robust_z(df: DataFrame, by: list[str], value: str | list[str], out: str | list[str] = "robust_z") -> DataFrame:
    """0.67449 (x - median) / max(MAD, 1e-12) of one or several columns, with exact medians (``exact_quantiles``) and one join for each pass."""
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)

    def middle(d: DataFrame, what: list[Column], name: str) -> DataFrame:
        long = d.select(*by, F.posexplode(F.array(*[w.cast("double") for w in what])).alias("_c", "_x"))
        q = exact_quantiles(long, [*by, "_c"], "_x", [0.5], "_q")
        return q.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == i, F.col("_q")[0])).alias(f"{name}{i}") for i in range(len(what))])

    def beside(d: DataFrame, m: DataFrame) -> DataFrame:
        m = m.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in m.columns if c not in by])
        on = F.lit(True)
        for i, k in enumerate(by):
            on = on & (d[k] == m[f"_k{i}"])
        return d.join(m, on).drop(*[f"_k{i}" for i in range(len(by))])

    d = beside(df, middle(df, [F.col(v) for v in values], "_m"))
    d = beside(d, middle(d, [F.abs(F.col(v) - F.col(f"_m{i}")) for i, v in enumerate(values)], "_d"))
    made = {o: 0.67449 * (F.col(v) - F.col(f"_m{i}")) / F.greatest(F.col(f"_d{i}"), F.lit(1e-12)) for i, (v, o) in enumerate(zip(values, outs))}
    return d.withColumns(made).drop(*[f"{x}{i}" for x in ("_m", "_d") for i in range(len(values))])


def artefact_scores(df: DataFrame, unit: list[str], trial: str, channel: str, value: str, amplitude: float, z: float = 5.0) -> DataFrame:
    """Per trial: largest peak-to-peak and magnitude, variance, channel-centred kurtosis; rejected by amplitude or a robust z."""
    ch = df.groupBy(*unit, trial, channel).agg((F.max(value) - F.min(value)).alias("p2p"), F.max(F.abs(value)).alias("top"), F.avg(value).alias("m1"),
                                                F.avg(F.col(value) ** 2).alias("m2"), F.avg(F.col(value) ** 3).alias("m3"), F.avg(F.col(value) ** 4).alias("m4"), F.count(value).alias("n"))
    c2 = F.col("m2") - F.col("m1") ** 2
    c4 = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.col("m1") ** 2 * F.col("m2") - 3 * F.col("m1") ** 4
    mean2, mean4 = F.sum(F.col("n") * c2) / F.sum("n"), F.sum(F.col("n") * c4) / F.sum("n")
    t = ch.groupBy(*unit, trial).agg(F.max("p2p").alias("peak_to_peak"), F.max("top").alias("max_abs"), mean2.alias("variance"), (mean4 / F.greatest(mean2 * mean2, F.lit(1e-300))).alias("kurtosis"))
    t = robust_z(t, unit, ["variance", "kurtosis"], ["variance_z", "kurtosis_z"])
    return t.withColumn("rejected", (F.col("peak_to_peak") > amplitude) | (F.col("variance_z") > z) | (F.col("kurtosis_z") > z))


def qc_decision(df: DataFrame, limits: list[tuple[str, Column]]) -> DataFrame:
    """``include`` and ``reasons`` from named conditions that exclude."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in limits]), lambda x: x.isNotNull())
    return df.withColumn("reasons", F.array_join(reasons, ";")).withColumn("include", F.size(reasons) == 0)


def average_reference(df: DataFrame, sample: list[str], value: str) -> DataFrame:
    return df.withColumn("referenced", F.col(value) - F.avg(value).over(Window.partitionBy(*sample)))


def baseline_corrected(df: DataFrame, by: list[str], time: str, value: str, low: float, high: float) -> DataFrame:
    base = F.avg(F.when(F.col(time).between(low, high), F.col(value))).over(Window.partitionBy(*by))
    return df.withColumn("corrected", F.col(value) - base)


def down_sampled(df: DataFrame, by: list[str], time: str, value: str, rate: float) -> DataFrame:
    """Means of time buckets of 1 / ``rate``; buckets without samples have no row, so it never up-samples."""
    return df.groupBy(*by, F.floor(F.col(time) * rate).alias("bucket")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def channel_missingness(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``all`` missing (fill with 0), ``some`` (an error) or ``none`` per channel."""
    miss = F.col(value).isNull() | F.isnan(value)
    return df.groupBy(*by).agg(F.when(F.bool_and(miss), "all").when(F.bool_or(miss), "some").otherwise("none").alias("missing"))


def filled_channels(df: DataFrame, by: list[str], channel: str, value: str) -> DataFrame:
    """Channels that are missing in all of a group's rows get 0 in ``value``; one that is missing in some is an error when a row of it is read. NaN counts as missing."""
    miss = F.col(value).isNull() | F.isnan(value)
    keys = [*by, channel]
    state = df.groupBy(*keys).agg(F.bool_and(miss).alias("_all"), F.bool_or(miss).alias("_some"))
    stop = F.raise_error(F.concat_ws(" ", F.lit("partly missing channel"), *[F.col(k).cast("string") for k in keys])).cast(df.schema[value].dataType)
    fill = F.when(F.col("_all"), F.lit(0).cast(df.schema[value].dataType)).when(F.col("_some"), stop).otherwise(F.col(value))
    return beside(df, state, keys).withColumn(value, fill).select(*df.columns)


def region_of(df: DataFrame, y: str, x: str) -> DataFrame:
    """Six regions: thirds of ``y`` (quantiles 1/3 and 2/3), left or right of ``x`` = 0."""
    q = df.agg(F.percentile(y, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    third = F.when(F.col(y) <= F.col("q")[0], "posterior").when(F.col(y) <= F.col("q")[1], "central").otherwise("anterior")
    return df.join(F.broadcast(q)).withColumn("region", F.concat_ws("-", third, F.when(F.col(x) < 0, "left").otherwise("right"))).drop("q")  # one row


def numbered(df: DataFrame, by: list[str], order: list[str], prefix: Column) -> DataFrame:
    """Zero-based, zero-padded ids in order."""
    return df.withColumn("trial_id", F.format_string("%s-%04d", prefix, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1))


def time_offsets(df: DataFrame, by: list[str], order: str, duration: str) -> DataFrame:
    """Start of each recording after those before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0.0)))


def paired_by_position(a: DataFrame, b: DataFrame, by: list[str], a_order: list[str], b_order: list[str]) -> DataFrame:
    """i-th with i-th row where both sides have as many rows."""
    def at(d, order):
        return d.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return at(a, a_order).join(at(b, b_order), [*by, "position", "_n"]).drop("_n")
