"""Grouped linear algebra over vector and matrix rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.numbering import numbered_rows


def moments(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Long sums ``i, j, s`` of x_i x_j per group with x_0 = 1 (so j, 0 are sums), for j <= i.

    Each task multiplies its vectors batch by batch and emits one triangle of
    sums per group it has seen; these are added up. Null vectors are left out,
    a null component is nothing to add to its sums, and all vectors of a table
    have one length.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def partial(batches):
        kept: dict[tuple, tuple[pa.RecordBatch, np.ndarray]] = {}
        for b in batches:
            pdf = b.to_pandas()
            for _, g in pdf.reset_index(drop=True).groupby(by, dropna=False, sort=False):
                x = np.array([np.asarray(v, float) for v in g["_v"]])
                x = np.hstack([np.ones((len(x), 1)), x])
                at = int(g.index[0])
                key = tuple(b.column(c)[at].as_py() for c in by)
                kept[key] = (b.select(by).slice(at, 1), kept[key][1] + x.T @ x if key in kept else x.T @ x)
        for row, s in kept.values():
            i, j = np.tril_indices(len(s))
            same = row.take(pa.array(np.zeros(len(i), np.int64)))
            yield pa.RecordBatch.from_arrays([*same.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=[*by, "i", "j", "s"])  # NaN stays NaN

    v = F.transform(vector, lambda c: F.coalesce(c.cast("double"), F.lit(0.0)))
    d = df.where(F.col(vector).isNotNull()).select(*by, v.alias("_v"))
    return d.mapInArrow(partial, f"{kinds}, i int, j int, s double").groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def _gram(pdf: pd.DataFrame) -> np.ndarray:
    n = int(pdf["i"].max()) + 1
    g = np.zeros((n, n))
    g[pdf["i"], pdf["j"]] = pdf["s"]
    return np.tril(g) + np.tril(g, -1).T


def _signed(vecs: np.ndarray) -> np.ndarray:
    return vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(vecs.shape[1])] < 0, -1, 1)


def whitening(df: DataFrame, by: list[str], vector: str, k: int, eps: float = 1e-9) -> DataFrame:
    """PCA whitening per group: ``mean``, ``components`` (k rows), ``eigenvalues``; from the moments alone. Rank below k is an error."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _gram(pdf)
        n, mean = g[0, 0], g[1:, 0] / g[0, 0]
        if not np.isfinite(g).all():
            raise ValueError("non-finite training rows")
        val, vec = np.linalg.eigh((g[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
        val, vec = val[::-1][:k], _signed(vec[:, ::-1][:, :k])
        if (val <= eps * val[0]).any():
            raise ValueError("rank below the number of components")
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "mean": [mean.tolist()], "components": [vec.T.tolist()], "eigenvalues": [val.tolist()]})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return moments(df, by, vector).groupBy(*by).applyInPandas(fit, f"{kinds}, mean array<double>, components array<array<double>>, eigenvalues array<double>")


def whitened(df: DataFrame, model: DataFrame, by: list[str], vector: str) -> DataFrame:
    """``white``: rows of components times (x - mean) over the root of the eigenvalue."""
    centred = F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m)
    project = F.zip_with("components", "eigenvalues", lambda c, v: F.aggregate(F.zip_with(c, "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.sqrt(v))
    return df.join(model, by).withColumn("_c", centred).withColumn("white", project).drop("_c", "mean", "components", "eigenvalues")


def unwhitened(df: DataFrame, model: DataFrame, by: list[str], white: str = "white", out: str = "restored") -> DataFrame:
    """``out``: the vector that ``white`` came from, as far as the kept components hold it: white times the root of the eigenvalue, along each component, plus the mean."""
    scaled = F.zip_with(white, "eigenvalues", lambda z, v: z * F.sqrt(v))
    parts = F.zip_with("components", "_s", lambda c, z: F.transform(c, lambda x: x * z))
    total = F.aggregate(parts, F.col("mean"), lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))
    return df.join(model, by).withColumn("_s", scaled).withColumn(out, total).drop("_s", "mean", "components", "eigenvalues")


def ridge(df: DataFrame, by: list[str], vector: str, target: str, penalty: float = 1.0) -> DataFrame:
    """Ridge readout with a free intercept: weights, intercept, residual sd (ddof 1), R squared."""
    x = df.withColumn("_x", F.concat(F.transform(vector, lambda c: c.cast("double")), F.array(F.col(target).cast("double"))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _gram(pdf)
        n, mean = g[0, 0], g[1:, 0] / g[0, 0]
        c = g[1:, 1:] - n * np.outer(mean, mean)
        w = np.linalg.solve(c[:-1, :-1] + penalty * np.eye(len(c) - 1), c[:-1, -1])
        sse = c[-1, -1] - 2 * w @ c[:-1, -1] + w @ c[:-1, :-1] @ w
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "weights": [w.tolist()], "intercept": [mean[-1] - w @ mean[:-1]], "residual_sd": [float(np.sqrt(max(sse, 0) / max(n - 1, 1)))], "r2": [1 - sse / c[-1, -1] if c[-1, -1] > 0 else np.nan]})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return moments(x, by, "_x").groupBy(*by).applyInPandas(fit, f"{kinds}, weights array<double>, intercept double, residual_sd double, r2 double")


def propagators(df: DataFrame, trial: list[str], t: str, matrix: str, horizon: int) -> DataFrame:
    """Ordered products J[t + h - 1] ... J[t] for each start of a trial with ``horizon`` steps left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        m = [np.array([list(r) for r in x], float) for x in pdf[matrix]]
        out = []
        for s in range(len(m) - horizon + 1):
            p = m[s]
            for j in range(s + 1, s + horizon):
                p = m[j] @ p
            out.append((*[pdf[c].iloc[0] for c in trial], pdf[t].iloc[s], p.tolist()))
        return pd.DataFrame(out, columns=[*trial, t, "propagator"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*trial, t])
    return df.groupBy(*trial).applyInPandas(run, f"{kinds}, propagator array<array<double>>")


def geometry(df: DataFrame, keys: list[str], matrix: str, blocks: list[int] | None = None) -> DataFrame:
    """Per matrix: gain (mean squared row norm), concentration (share of the top direction), effective rank, normalised entropy of block energy."""

    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf[matrix]:
                m = np.array([list(r) for r in x], float)
                e = np.linalg.svd(m, compute_uv=False) ** 2
                total = e.sum()
                p = e[e > 0] / total if total else np.ones(1)
                b = np.add.reduceat((m * m).sum(1), [0, *np.cumsum(blocks)[:-1]] if blocks else np.arange(len(m)))
                q = b[b > 0] / b.sum() if b.sum() else np.ones(1)
                rows.append((total / len(m), float(p.max()), float(np.exp(-(p * np.log(p)).sum())), float(-(q * np.log(q)).sum() / np.log(len(b))) if len(b) > 1 else 0.0))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["gain", "concentration", "effective_rank", "broadcast"])], axis=1)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.select(*keys, matrix).mapInPandas(run, f"{kinds}, gain double, concentration double, effective_rank double, broadcast double")


def without_direction(df: DataFrame, vector: str, basis: str) -> DataFrame:
    """The vector less its component along ``basis``."""
    d = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    c = d(vector, basis) / d(basis, basis)
    return df.withColumn("_k", c).withColumn("removed", F.zip_with(vector, basis, lambda x, y: x.cast("double") - F.col("_k") * y.cast("double"))).drop("_k")


def random_basis(dim: int, k: int, seed: str) -> np.ndarray:
    """``k`` orthonormal rows of ``dim``: the QR factor of a matrix of normal numbers made of SHA-256 of (seed, row, column), the same everywhere.

    Two hashed uniforms make each normal number; columns get the sign that
    makes the triangular factor's diagonal positive, so the basis is one.
    """
    if not 0 < k <= dim:
        raise ValueError("a basis has between 1 and dim rows")
    u = np.array([np.frombuffer(hashlib.sha256(f"{seed}|{i}|{j}".encode()).digest()[:16], ">u8").astype(float) for i in range(dim) for j in range(k)]) / 2**64
    normal = np.sqrt(-2 * np.log(np.maximum(u[:, 0], 2.0**-64))) * np.cos(2 * np.pi * u[:, 1])
    q, r = np.linalg.qr(normal.reshape(dim, k))
    return (q * np.where(np.diag(r) < 0, -1, 1)).T


def without_subspace(df: DataFrame, vector: str, bases: dict[str, np.ndarray]) -> DataFrame:
    """``df`` with ``basis`` and ``removed`` for every named basis (orthonormal rows): the vector less its projection.

    A row is made for each basis, as when a targeted basis is set against
    random ones. Bases are a few small matrices and go to the tasks; rows with
    a null vector have a null ``removed``.
    """
    if not bases:
        raise ValueError("no basis")
    names, mats = list(bases), [np.atleast_2d(np.asarray(b, float)) for b in bases.values()]
    for b in mats:
        if not np.allclose(b @ b.T, np.eye(len(b)), atol=1e-8):
            raise ValueError("rows of a basis must be orthonormal")

    @F.pandas_udf("array<array<double>>")
    def rests(v: pd.Series) -> pd.Series:
        x = np.array(v.to_list(), float).reshape(len(v), -1)
        each = [x - x @ b.T @ b for b in mats] if len(v) else []
        return pd.Series([[list(e[i]) for e in each] for i in range(len(v))], dtype=object)

    there = F.col(vector).isNotNull()
    zero = F.array_repeat(F.lit(0.0), mats[0].shape[1])
    d = df.withColumn("_r", rests(F.when(there, F.transform(vector, lambda c: c.cast("double"))).otherwise(zero)))
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    return d.withColumn("basis", F.element_at(F.array(*map(F.lit, names)), F.col("_k"))).withColumn("removed", F.when(there, F.element_at("_r", F.col("_k")))).drop("_r", "_k")


def similarity_moments(df: DataFrame, unit: list[str], trial: list[str], t: str, vector: str, centred: bool = True, eps: float = 1e-8) -> DataFrame:
    """``unit, t, s, mean, variance, n``: the cosine of each two times of a trial, its mean and population variance over the unit's trials.

    With ``centred`` a vector's own mean is taken off first; lengths below
    ``eps`` count as ``eps``, so a constant vector is like no other. Rows are
    dealt by trial; a task multiplies each trial's matrix with itself, carries
    counts, means and squares of each unit's cells on from trial to trial, and
    hands on one row for each cell, which are then merged. Null vectors are left
    out; a time that a trial repeats is an error.
    """
    keys = list(dict.fromkeys([*unit, *trial]))

    def run(batches):
        whole, held = None, []  # the current unit and its sums; the current trial's rows
        times: dict = {}
        n = mean = m2 = None

        def add(rows):
            nonlocal n, mean, m2
            x = np.array([r[1] for r in rows], float)
            x = x - x.mean(1, keepdims=True) if centred else x
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)
            at = [times.setdefault(r[0], len(times)) for r in rows]
            if len(set(at)) < len(at):
                raise ValueError("a trial repeats a time")
            grow = len(times) - len(n)
            if grow:
                n, mean, m2 = (np.pad(a, (0, grow)) for a in (n, mean, m2))
            for low in range(0, len(at), 256):
                part = np.ix_(at[low:low + 256], at)
                c = x[low:low + 256] @ x.T
                n[part] += 1
                off = c - mean[part]
                mean[part] += off / n[part]
                m2[part] += off * (c - mean[part])

        def cells():
            i, j = np.nonzero(n)
            names = list(times)
            yield pd.DataFrame({**{k: [v] * len(i) for k, v in zip(unit, whole)}, "t": [names[k] for k in i], "s": [names[k] for k in j], "n": n[i, j].astype(np.int64), "mean": mean[i, j], "m2": m2[i, j]})

        last = None
        for pdf in batches:
            where = [pdf.columns.get_loc(k) for k in keys]
            for r in pdf.itertuples(index=False, name=None):
                key = tuple(r[k] for k in where)
                if key != last and held:
                    add(held)
                    held = []
                if key[:len(unit)] != whole:
                    if whole is not None:
                        yield from cells()
                    whole, times, n, mean, m2 = key[:len(unit)], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0))
                last = key
                held.append(r[-2:])
        if held:
            add(held)
            yield from cells()

    v = F.transform(vector, lambda c: c.cast("double"))
    d = df.where(F.col(vector).isNotNull()).select(*keys, F.col(t).alias("_t"), v.alias("_v")).repartition(*keys).sortWithinPartitions(*keys, "_t")
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in unit)
    kind = df.schema[t].dataType.simpleString()
    parts = d.mapInPandas(run, f"{kinds}t {kind}, s {kind}, n long, mean double, m2 double")
    # squares around the common mean, from those around each part's own
    w = parts.groupBy(*unit, "t", "s").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("a"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))  # one part for each task
    centre = w.withColumn("mean", F.col("a") / F.col("n"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return centre.select(*unit, "t", "s", "mean", (total / F.col("n")).alias("variance"), "n")


def similarity_cells(df: DataFrame, trial: list[str], t: str, vector: str) -> DataFrame:
    """Cosine of each two times of a trial, then its mean and population variance over trials by cell."""
    return similarity_moments(df, [], trial, t, vector, centred=False)


def pooled_cells(df: DataFrame) -> DataFrame:
    """Unit-equal pooling of cell means and variances by the law of total variance."""
    return df.groupBy("t", "s").agg(F.avg("mean").alias("mean"), (F.avg("variance") + F.var_pop("mean")).alias("variance"), F.sum("n").alias("n"))


def alignment_distance(a: DataFrame, b: DataFrame, weight: float = 1.0) -> DataFrame:
    """Off-diagonal mean squared difference of means plus ``weight`` times that of variances, over the cells of both."""
    j = a.alias("a").join(b.alias("b"), ["t", "s"]).where("t <> s")
    return j.agg((F.avg((F.col("a.mean") - F.col("b.mean")) ** 2) + weight * F.avg((F.col("a.variance") - F.col("b.variance")) ** 2)).alias("distance"))


def joint_permutation(df: DataFrame, i: str, j: str, value: str, seed: int = 1) -> DataFrame:
    """A matrix in long form with rows and columns under one hash-ordered permutation of labels."""
    names = df.select(F.col(i).alias("n")).unionByName(df.select(F.col(j).alias("n"))).distinct()
    place = numbered_rows(names, [], ["n"], "k")
    hashed = names.select(F.col("n").alias("m"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("n").cast("string")), 256).alias("_h"))
    mixed = numbered_rows(hashed, [], ["_h", "m"], "k").drop("_h")
    perm = place.join(mixed, "k").select("n", "m")
    return df.join(perm.select(F.col("n").alias(i), F.col("m").alias("_i")), i).join(perm.select(F.col("n").alias(j), F.col("m").alias("_j")), j).select(F.col("_i").alias(i), F.col("_j").alias(j), value)


def scored_dynamics(df: DataFrame, keys: list[str], state: str, params: dict[str, np.ndarray], rate: float = 0.1) -> DataFrame:
    """Next state and its derivative under given residual dynamics: x + rate (A x + U tanh(V x + b)). No training."""
    a, u, v, b = (np.asarray(params[k], float) for k in ("A", "U", "V", "b"))

    def run(batches):
        for pdf in batches:
            x = np.array(pdf[state].to_list(), float).reshape(-1, len(a))
            h = np.tanh(x @ v.T + b)
            step = x + rate * (x @ a.T + h @ u.T)
            slope = np.eye(len(a)) + rate * (a + (u[None] * (1 - h * h)[:, None, :]) @ v)
            yield pdf[keys].assign(next_state=list(step), jacobian=[list(map(list, j)) for j in slope])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.select(*keys, state).mapInPandas(run, f"{kinds}, next_state array<double>, jacobian array<array<double>>")


def output_maps(df: DataFrame, trial: list[str], t: str, matrix: str, blocks: dict[str, np.ndarray], sds: dict[str, np.ndarray], horizons: list[int]) -> DataFrame:
    """Standardised output maps times the propagators of every horizon, on the starts that the longest horizon has.

    ``map`` stacks the rows block by block, in a block horizon by horizon; a
    block's rows are divided by their residual sd and the root of their number.
    """
    parts = {k: np.asarray(m, float) / np.asarray(sds[k], float)[:, None] / np.sqrt(len(m)) for k, m in blocks.items()}
    order, longest = sorted(horizons), max(horizons)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        m, rows = [np.array([list(r) for r in x], float) for x in pdf[matrix]], []
        for s in range(len(m) - longest + 1):
            p, at = np.eye(len(m[s])), {}
            for j in range(longest):
                p = m[s + j] @ p
                at[j + 1] = p
            rows.append((*[pdf[c].iloc[0] for c in trial], pdf[t].iloc[s], np.concatenate([o @ at[h] for o in parts.values() for h in order]).tolist()))
        return pd.DataFrame(rows, columns=[*trial, t, "map"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*trial, t])
    return df.groupBy(*trial).applyInPandas(run, f"{kinds}, map array<array<double>>")


def subspace_metrics(df: DataFrame, trial: list[str], t: str, matrix: str, block_rows: list[int], k: int = 2, lag: int = 5) -> DataFrame:
    """Per (trial, t): entropy of the block energies in the top ``k`` directions, and the mean squared canonical correlation with those ``lag`` later (null at the tail)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        m = np.stack([np.array([list(r) for r in x], float) for x in pdf[matrix]])
        top = np.linalg.svd(m, full_matrices=False)[2][:, :k]
        energy = np.add.reduceat(((m @ top.transpose(0, 2, 1)) ** 2).sum(2), [0, *np.cumsum(block_rows)[:-1]], axis=1)
        total = energy.sum(1)
        p = energy / np.where(total > 0, total, 1)[:, None]
        spread = -(p * np.log(np.where(p > 0, p, 1))).sum(1) / np.log(len(block_rows)) if len(block_rows) > 1 else np.ones(len(m))
        lasting = [None] * len(m)
        if len(m) > lag:
            cc = np.linalg.svd(top[:-lag] @ top[lag:].transpose(0, 2, 1), compute_uv=False)
            lasting[: len(m) - lag] = (cc**2).mean(1).tolist()
        return pdf[[*trial, t]].assign(broadcast=[float(x) if e > 0 else None for x, e in zip(spread, total)], persistence=lasting)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*trial, t])
    return df.groupBy(*trial).applyInPandas(run, f"{kinds}, broadcast double, persistence double")
